"""A cache of answers by key that is kept in segments and buckets: appends, compaction, lookups that read the keys' buckets only.

``path`` holds ``answers/seg=<n>/bucket=<b>`` (sorted by key) and manifests. Of a key that was put more than once the
answer of the latest segment counts, within a segment the first by text. Answers are texts; objects are put as
their JSON, under the digest of what they were made from (``object_key``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from versight.functions import manifest
from versight.functions.store import written

COLUMNS = ("key", "provider", "model", "temperature", "messages", "output")


def exists(spark: SparkSession, path: str) -> bool:
    return bool(manifest.versions(spark, path))


def create(spark: SparkSession, path: str, *, buckets: int = 64) -> None:
    manifest.commit(spark, path, {"version": 0, "next": 1, "buckets": buckets, "segments": []})


def object_key(namespace: str, payload: Column) -> Column:
    """The key of an object: the digest of its namespace and of the JSON of what it was made from."""
    return F.sha2(F.concat(F.lit(f"{namespace}\n"), F.to_json(F.struct(payload.alias("payload")))), 256)


def _bucket(told: dict) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(told["buckets"])).cast("int")


def _write(rows: DataFrame, path: str, told: dict, segments: list[dict]) -> None:
    """``rows``, one a key, as the next segment of a version that has it and ``segments``."""
    spark, number = rows.sparkSession, told["next"]
    dealt = rows.withColumn("bucket", _bucket(told)).repartition(F.col("bucket"))
    dealt.sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/answers/seg={number}")
    n = spark.read.option("basePath", f"{path}/answers").parquet(f"{path}/answers/seg={number}").count()
    manifest.commit(spark, path, told | {"version": told["version"] + 1, "next": number + 1, "segments": [*segments, {"seg": number, "n": n}]})


def put(answers: DataFrame, path: str) -> None:
    """Appends answers (key, output, and of the others of ``COLUMNS`` what there is); null keys and outputs aren't kept."""
    spark = answers.sparkSession
    told = manifest.read(spark, path)
    rows = answers.select(*(c for c in COLUMNS if c in answers.columns)).where("key is not null and output is not null")
    first = F.min_by(F.struct(*(c for c in rows.columns if c != "key")), "output").alias("x")
    rows = written(rows.groupBy("key").agg(first).select("key", "x.*"), "answers")
    if not rows.isEmpty():
        _write(rows, path, told, told["segments"])


def _rows(spark: SparkSession, path: str, told: dict) -> DataFrame:
    names = [f"{path}/answers/seg={s['seg']}" for s in told["segments"]]
    return spark.read.option("basePath", f"{path}/answers").option("mergeSchema", "true").parquet(*names)


def _latest(rows: DataFrame) -> DataFrame:
    """One row a key: that of the latest segment. A key occurs once in a segment, so a group has a row a segment at most."""
    return rows.groupBy("key").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("key", "seg", "bucket"))), "seg").alias("x")).select("key", "x.*")


def get(keys: DataFrame, path: str, *, version: int | None = None) -> DataFrame:
    """(key, output) of those of ``keys`` (key) that are kept; only the files of their buckets are read."""
    spark = keys.sparkSession
    told = manifest.read(spark, path, version)
    asked = keys.select("key").where("key is not null").distinct()
    if not told["segments"]:
        return asked.select("key", F.lit(None).cast("string").alias("output")).limit(0)
    buckets = sorted(r[0] for r in asked.select(_bucket(told)).distinct().collect())
    rows = _rows(spark, path, told).where(F.col("bucket").isin(buckets)).select("key", "output", "seg")
    return _latest(rows.join(asked, "key", "left_semi"))


def compact(spark: SparkSession, path: str) -> None:
    """Merges all segments into one; old files stay for readers of older versions until ``vacuum``."""
    told = manifest.read(spark, path)
    if len(told["segments"]) > 1:
        _write(written(_latest(_rows(spark, path, told)), "answers"), path, told, [])


def vacuum(spark: SparkSession, path: str) -> list[str]:
    return manifest.vacuum(spark, path, {"answers": {s["seg"] for s in manifest.read(spark, path)["segments"]}})


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row: segments, answers put (of segments that count) and keys."""
    told = manifest.read(spark, path)
    n = _rows(spark, path, told).select("key").distinct().count() if told["segments"] else 0
    return spark.createDataFrame([(len(told["segments"]), sum(s["n"] for s in told["segments"]), n)], "segments long, answers long, unique_keys long")
