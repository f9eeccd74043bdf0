"""Running totals over all rows of a table, by ranges: no task sees more than its range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight.functions.store import written


def running(rows: DataFrame, order: list[Column | str], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``totals``, the sum over the rows up to and with this one in the given order.

    Rows are dealt by ranges of the order and written; sums run within a range, and ranges are
    offset by the totals of those before, one row a range.
    """
    dealt = written(rows.withColumns({f"_x{i}": c for i, c in enumerate(totals.values())}).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_part").agg(*(F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(totals))))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_part", *(F.coalesce(F.sum(f"_s{i}").over(earlier), F.lit(0)).alias(f"_s{i}") for i in range(len(totals))))
    within = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.join(F.broadcast(starts), "_part")
    out = placed.withColumns({name: F.col(f"_s{i}") + F.sum(f"_x{i}").over(within) for i, name in enumerate(totals)})
    return out.drop("_part", *(f"_{k}{i}" for i in range(len(totals)) for k in "xs"))
