"""Connected components by alternating large-star and small-star steps, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from versight.llm.shared import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its larger neighbours to its least neighbour. Small: itself and its smaller ones."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    moved = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(u, v): v is the least node of u's component, for each node u that is not the least.

    ``edges`` has columns u and v of one orderable type; nulls and loops are ignored.
    Each round is one job whose result is written to the shared folder, and whose
    predecessor's files go. Minima are aggregated before the shuffle; a hub's edges meet
    its minimum in a join of one row with many, which adaptive execution splits. Rounds
    grow with the logarithm of the number of nodes; ``max_rounds`` only guards against an error and
    raises when reached.
    """
    now = written(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            return now
        last, now = now, written(_star(_star(now, True), False), "edges")
        discard(last)
        after = mark(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
