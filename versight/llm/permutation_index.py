"""Approximate nearest neighbours by permutations of pivots.

A vector is represented by its ``places`` nearest pivots, nearest first. The index is a written
table of segments (some thousand rows each): their vectors, and a pivot inverted file, that is for
each pivot the rows that have it among their nearest ones, with its place. A query walks the
lists of its own nearest pivots. Its footrule distance to a row is the sum, over pivots,
of the difference of the places; a pivot that one of both lacks has place ``places`` there. So a
shared pivot at places i and j saves 2 * (places - max(i, j)) against sharing none, and rows on none of
the query's lists are farthest. Per segment the best ``share`` by footrule is reranked by the
exact distance, and each task keeps its k best of a query.

Pivots are a bounded sample (``pivots`` rows, those of least hash). Every row is indexed. The
queries meet the segments in blocks of about ``block`` queries that are broadcast, whose size is
bounded; each block is one pass over the index. What is shuffled is k rows for each query and
task. The rank that is reranked is a share, not a number: where vectors are close to uniform no
fixed number keeps the recall as tables grow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight.llm.shared import written

#: Rows of a segment at most, and rows that are always reranked.
SEGMENT_ROWS, LEAST_RERANKED = 8192, 256


def usable(vector: Column) -> Column:
    """Not null, no component null, NaN or infinite, and one that isn't zero."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(x, lambda v: v != 0)


def permutations(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first, ties to the lower pivot."""
    near = (pivots * pivots).sum(1)[None, :] - 2 * vectors @ pivots.T
    some = np.sort(np.argpartition(near, places - 1, axis=1)[:, :places], axis=1)
    order = np.argsort(np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int32)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def inverted(order: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends of the pivots' lists, rows, places): the lists one after another."""
    rows, places = np.divmod(np.arange(order.size), order.shape[1])
    by = np.argsort(order.ravel(), kind="stable")
    return np.searchsorted(order.ravel()[by], np.arange(pivots), side="right"), rows[by].astype(np.int32), places[by].astype(np.int32)


def saved(order: np.ndarray, ends: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How far below the largest footrule distance each of the n rows is, by the lists of a query's pivots."""
    begin, end = np.where(order > 0, ends[order - 1], 0), ends[order]
    size = end - begin
    own = np.repeat(np.arange(len(order)), size)
    found = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return np.bincount(rows[found], weights=len(order) - np.maximum(at[found], own), minlength=n)


def build(rows: DataFrame, pivots: np.ndarray, places: int) -> DataFrame:
    """The written index of ``rows`` (id, vector): one row a segment."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SEGMENT_ROWS):
                batch = whole.slice(i, SEGMENT_ROWS)
                vectors = _matrix(batch.column(1))
                ends, at, place = inverted(permutations(vectors, shared.value, places), len(shared.value))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()]) for x in (vectors, ends, at, place))], names=["ids", "vectors", "ends", "rows", "places"])

    return written(rows.mapInArrow(post, "ids array<long>, vectors binary, ends binary, rows binary, places binary"), "permutations")


def _nearest(queries, k: int, share: float):
    """Reads segments; yields the k best rows of each query that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, vectors, orders = queries.value
        best = [(np.empty(0), np.empty(0, np.int64))] * len(keys)
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.array(batch.column(0)[row].as_py(), np.int64)
                there, ends, at, place = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in ((1, np.float64), (2, np.int64), (3, np.int32), (4, np.int32)))
                there = there.reshape(len(ids), -1)
                depth = max(LEAST_RERANKED, math.ceil(share * len(ids)))
                by_id = np.argsort(ids, kind="stable")
                for q in range(len(keys)):
                    score = saved(orders[q], ends, at, place, len(ids)).astype(np.int64)
                    # equal footrules: smaller ids first
                    rank = score * len(ids)
                    rank[by_id] += np.arange(len(ids))[::-1]
                    rank[ids == own[q]] = -1
                    some = np.argpartition(-rank, depth)[:depth] if depth < len(ids) else np.arange(len(ids))
                    some = some[rank[some] >= 0]
                    apart = np.sqrt(((there[some] - vectors[q]) ** 2).sum(1))
                    d, i = np.concatenate([best[q][0], apart]), np.concatenate([best[q][1], ids[some]])
                    if len(d) > 4 * k:  # what may be among the k best, ties at the edge too
                        keep = d <= np.partition(d, k - 1)[k - 1]
                        d, i = d[keep], i[keep]
                    first = np.lexsort((i, d))[:k]
                    best[q] = d[first], i[first]
        for q, (d, i) in enumerate(best):
            if len(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), keys[q])), pa.array(np.full(len(d), own[q])), pa.array(i), pa.array(d)], names=["query", "query_id", "vec_id", "score"])

    return run


def search(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, pivots: int = 512, places: int = 64, share: float = 0.25, block: int = 1 << 15) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the nearest rows found of each query.

    Queries are the rows whose id is divisible by ``every``; each is answered from all rows of
    other ids, ties to smaller ids. Rows without an id, and vectors that are null, zero or hold a null or a
    number that isn't finite, take no part; nor do vectors whose length isn't the commonest (of
    equally common ones the smaller). Repeated queries are answered each, repeated rows found each.
    An empty table gives an empty result; only the two named columns are read.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == sizes["size"])
    sample = rows.select("vector", F.xxhash64("id", "vector").alias("h"), "id").orderBy("h", "id").limit(4 * pivots).toArrow()
    found = _matrix(sample["vector"].combine_chunks())
    chosen = found[np.sort(np.unique(found, axis=0, return_index=True)[1])[:pivots]]
    places = min(places, len(chosen))
    index = build(rows, chosen, places)

    asked = written(rows.where(F.col("id") % every == 0).select(F.monotonically_increasing_id().alias("query"), "id", "vector"), "queries")
    parts = max(1, -(-asked.count() // block))
    passes = []
    for turn in range(parts):
        now = (asked.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == turn) if parts > 1 else asked).toArrow().combine_chunks()
        vectors = _matrix(now["vector"].combine_chunks()) if len(now) else np.empty((0, sizes["size"]))
        shared = spark.sparkContext.broadcast((now["query"].to_numpy(), now["id"].to_numpy(), vectors, permutations(vectors, chosen, places)))
        passes.append(index.mapInArrow(_nearest(shared, k, share), "query long, query_id long, vec_id long, score double"))
    place = F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))
    return reduce(DataFrame.unionAll, passes).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
