"""A BM25 index that is kept: postings on disk in segments and buckets of tokens, with appends, deletes and merged statistics.

``path`` holds ``postings/seg=<n>/bucket=<b>`` (token, docs, lens, tfs: a token's postings in a block of documents; sorted by
token), ``docs/seg=<n>`` (doc, len), ``deletes/seg=<n>`` (doc), and a manifest for each version (see ``functions.manifest``) that
names the segments and deletes which count, with their numbers of documents and tokens. A delete hits what was appended before it.
Statistics of the corpus come from the manifest alone; document frequencies from the postings that a query
reads, which are those of its tokens in their buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from versight.functions import manifest as versions
from versight.functions.store import discard, written
from versight.operators import bm25

#: Postings of a file within a bucket, about.
FILE_POSTINGS = 1 << 22
#: Bytes of texts whose postings are grouped by token in a task, about; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Documents of a block where segments are merged, about.
BLOCK_DOCS = 1 << 14
#: Bytes of lower-cased texts that are part of a token, as in ``text.tokenise``.
_OF_TOKEN = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789'", np.uint8))


def create(spark: SparkSession, path: str, *, buckets: int = 64) -> None:
    versions.commit(spark, path, {"version": 0, "next": 1, "buckets": buckets, "segments": [], "deletes": []})


def _bucket(told: dict):
    return F.pmod(F.xxhash64("token"), F.lit(told["buckets"])).cast("int")


def _block(docs: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """A row a token (docs, lens, tfs), and one without token that has all documents. Texts end with a blank."""
    edges = np.flatnonzero(np.diff(_OF_TOKEN[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    kept = ends - starts >= 3
    starts, ends = starts[kept], ends[kept]
    doc = np.searchsorted(offsets, starts, "right") - 1
    marks = np.zeros(len(data) + 1, np.int8)
    marks[starts], marks[ends] = 1, -1
    letters = data[np.cumsum(marks[:-1], dtype=np.int8).view(bool)]
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(letters)).dictionary_encode()
    pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + doc, return_counts=True)
    code, at = np.divmod(pairs, len(docs))
    lens, every = np.bincount(doc, minlength=len(docs)), np.arange(len(docs))
    begins = np.append(np.searchsorted(code, np.arange(len(coded.dictionary) + 1)), len(at) + len(docs)).astype(np.int32)
    lists = lambda values: pa.ListArray.from_arrays(pa.array(begins), values)
    numbers = lambda own, last: lists(pa.array(np.concatenate((own, last)).astype(np.int32)))
    tokens = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
    return pa.RecordBatch.from_arrays([tokens, lists(docs.take(pa.array(np.concatenate((at, every))))), numbers(lens[at], lens), numbers(tf, every * 0)], names=["token", "docs", "lens", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, docs, lens, tfs) of (doc, lower-cased text with a blank behind it)."""
    for batch in batches:
        docs, texts = batch.column(0), batch.column(1).cast(pa.large_string())
        if not len(texts):
            continue
        _, places, data = texts.buffers()
        offsets, data = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data, np.uint8)
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + BLOCK_BYTES, "right")) - 1)
            low, high = offsets[begin], offsets[end]
            yield _block(docs.slice(begin, end - begin), data[low:high], offsets[begin : end + 1] - low)
            begin = end


def _exploded(lists: DataFrame, *more: str) -> DataFrame:
    """(token, doc, len, tf and more) of posting lists."""
    rows = lists.select("token", *more, F.explode(F.arrays_zip("docs", "lens", "tfs")).alias("x"))
    return rows.select("token", *more, F.col("x.docs").alias("doc"), F.col("x.lens").alias("len"), F.col("x.tfs").cast("long").alias("tf"))


def _write_segment(lists: DataFrame, docs: DataFrame, path: str, told: dict, number: int) -> dict:
    """Writes one segment; its entry of the manifest."""
    salts = 1 + (lists.agg(F.sum(F.size("docs"))).first()[0] or 0) // (told["buckets"] * FILE_POSTINGS)
    rows = lists.select("token", "docs", "lens", "tfs", _bucket(told).alias("bucket"))
    dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("docs"), F.lit(salts))) if salts > 1 else rows.repartition(F.col("bucket"))
    dealt.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/postings/seg={number}")
    docs.select("doc", "len").write.parquet(f"{path}/docs/seg={number}")
    n = docs.sparkSession.read.parquet(f"{path}/docs/seg={number}").agg(F.count("*").alias("n"), F.sum("len").alias("len")).first()
    return {"seg": number, "n": n["n"], "len": n["len"] or 0}


def append(docs: DataFrame, path: str, *, key: str, text_col: str = "text") -> None:
    """Adds documents as a segment. Keys have to be unique among those that live.

    Tasks group the postings of a block of texts by token, so a row that is dealt and sorted is a token's list in a block.
    """
    spark = docs.sparkSession
    told = versions.read(spark, path)
    kind = docs.select(key).schema[0].dataType.simpleString()
    texts = docs.select(F.col(key).alias("doc"), F.concat(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(" ")).alias("text"))
    lists = written(texts.mapInArrow(_blocks, f"token string, docs array<{kind}>, lens array<int>, tfs array<int>"), "lists")
    own = _exploded(lists.where("token is null")).select("doc", "len")
    entry = _write_segment(lists.where("token is not null"), own, path, told, told["next"])
    discard(lists)
    versions.commit(spark, path, told | {"version": told["version"] + 1, "next": told["next"] + 1, "segments": [*told["segments"], entry]})


def _read(spark: SparkSession, path: str, told: dict, what: str) -> DataFrame:
    """All rows of ``docs`` or ``postings`` that a version has, also of deleted documents."""
    return spark.read.option("basePath", f"{path}/{what}").parquet(*(f"{path}/{what}/seg={s['seg']}" for s in told["segments"]))


def _living(rows: DataFrame, path: str, told: dict) -> DataFrame:
    """Rows (doc, seg) whose document no later delete names."""
    if not told["deletes"]:
        return rows
    gone = rows.sparkSession.read.option("basePath", f"{path}/deletes").parquet(*(f"{path}/deletes/seg={d['seg']}" for d in told["deletes"]))
    gone = gone.groupBy("doc").agg(F.max("seg").alias("gone"))
    return rows.join(gone, "doc", "left").where("gone is null or gone < seg").drop("gone")


def delete(keys: DataFrame, path: str) -> None:
    """Removes the documents of ``keys`` (doc) that live now; others are ignored, and a key may be appended again later."""
    spark = keys.sparkSession
    told = versions.read(spark, path)
    if not told["segments"]:
        return
    hit = written(_living(_read(spark, path, told, "docs"), path, told).join(keys.select("doc").distinct(), "doc").select("doc", "len"), "deleted")
    n = hit.agg(F.count("*").alias("n"), F.sum("len").alias("len")).first()
    if not n["n"]:
        return
    hit.select("doc").write.parquet(f"{path}/deletes/seg={told['next']}")
    entry = {"seg": told["next"], "n": n["n"], "len": n["len"] or 0}
    versions.commit(spark, path, told | {"version": told["version"] + 1, "next": told["next"] + 1, "deletes": [*told["deletes"], entry]})


def compact(spark: SparkSession, path: str) -> None:
    """Merges all that lives into one segment; the old files stay for readers of older versions (see ``vacuum``)."""
    told = versions.read(spark, path)
    if not told["segments"]:
        return
    own = _living(_read(spark, path, told, "docs"), path, told)
    blocks = 1 + statistics(told)[0] // BLOCK_DOCS
    rows = _living(_exploded(_read(spark, path, told, "postings"), "seg"), path, told)
    grouped = rows.groupBy("token", F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("doc", "len", "tf")).alias("x"))
    lists = written(grouped.select("token", F.col("x.doc").alias("docs"), F.col("x.len").alias("lens"), F.col("x.tf").cast("array<int>").alias("tfs")), "living")
    entry = _write_segment(lists, own, path, told, told["next"])
    discard(lists)
    versions.commit(spark, path, told | {"version": told["version"] + 1, "next": told["next"] + 1, "segments": [entry], "deletes": []})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Removes files that the latest version doesn't name, and older manifests; returns what went."""
    told = versions.read(spark, path)
    own = {s["seg"] for s in told["segments"]}
    return versions.vacuum(spark, path, {"postings": own, "docs": own, "deletes": {d["seg"] for d in told["deletes"]}})


def statistics(told: dict) -> tuple[int, float]:
    """(documents, their average length) of a version, from the manifest."""
    n, total = (sum(s[k] for s in told["segments"]) - sum(d[k] for d in told["deletes"]) for k in ("n", "len"))
    return n, total / n if n else 0.0


def postings(spark: SparkSession, path: str, tokens: DataFrame, told: dict) -> DataFrame:
    """Posting lists of the tokens' buckets, also of deleted documents; other buckets' files aren't read."""
    asked = sorted(r[0] for r in tokens.select(_bucket(told)).distinct().collect())
    return _read(spark, path, told, "postings").where(F.col("bucket").isin(asked))


def search(spark: SparkSession, path: str, tokens: DataFrame, *, version: int | None = None, k: int | None = None) -> DataFrame:
    """(query, doc, score) of ``tokens`` (query, token, m, see ``bm25.query_tokens``) in a version, the latest if none is named.

    With ``k`` only what ``bm25.top_k`` needs for that many of each query (see ``bm25.candidates``).
    """
    told = versions.read(spark, path, version)
    if not told["segments"]:
        return spark.createDataFrame([], "query long, doc long, score double")
    lists = postings(spark, path, tokens, told).join(tokens.select("token").distinct(), "token", "left_semi")
    tf = written(_living(_exploded(lists, "seg"), path, told).select("doc", "len", "token", "tf"), "asked")
    n, avgdl = statistics(told)
    stats = spark.createDataFrame([(n, avgdl)], "n long, avgdl double")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    return bm25.scores(tf, df, stats, tokens) if k is None else bm25.candidates(tf, df, stats, tokens, k)
