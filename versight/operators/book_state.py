"""Timelines, co-occurrence and profiles as partial states of books that are kept and merged.

``path`` holds segments of the parts below, ``<part>/seg=<n>``, and manifests (``functions.manifest``). A segment has the states of the
books that arrived together, which don't depend on any other book; one that goes is named by a later removal. What is read
is merged: counts are summed, first places and best chunks are taken over books in their order. So what is read equals what would be
made from all chunks anew, and neither an arrival nor a departure reads another book.

    books     book_name, n_chunks, first        chunks, and the number of the first one when it arrived
    pairs     book_name, left, right, same_chunk, same_chapter, nearby_chunks
    frames    as ``timeline.build``
    mentions  book_name, character, n, at, chunk_id, chapter_id   mentions, and the first one
    dense     book_name, character, score, at, chunk_id           the eight densest chunks
    values    book_name, character, kind, v, n, at, p             what it is mentioned with, and where first
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from versight.functions import manifest
from versight.functions.ranges import running
from versight.functions.store import written
from versight.operators import anchors as A, timeline

PARTS = ("books", "pairs", "frames", "mentions", "dense", "values")


def create(spark: SparkSession, path: str) -> None:
    manifest.commit(spark, path, {"version": 0, "next": 1, "segments": [], "removals": []})


def _profile_parts(met: DataFrame) -> dict[str, DataFrame]:
    by = ["book_name", "character"]
    entry = lambda kind: lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("v"), i.alias("p"))
    lists = [F.transform(F.col(values), entry(kind)) for kind, values in timeline.PROFILE_LISTS.items()]
    best = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("plot_density_score"), "at"))
    return {
        "mentions": met.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("at", "chunk_id", "chapter_id")).alias("x")).select(*by, "n", "x.*"),
        "dense": met.withColumn("r", best).where("r <= 8").select(*by, F.col("plot_density_score").alias("score"), "at", "chunk_id"),
        "values": met.select(*by, "at", F.explode(F.concat(*lists)).alias("x")).groupBy(*by, "x.kind", "x.v").agg(F.count("*").alias("n"), F.min(F.struct("at", "x.p")).alias("s")).select(*by, "kind", "v", "n", "s.*"),
    }


def add(chunks: DataFrame, path: str, targets, *, canonical=A.canonical) -> None:
    """The states of the books of annotated ``chunks`` (with ``chunk_index_global``, whose order counts within a book). A book that is kept already has to be removed before.

    Without ``targets`` no profiles are kept, in any segment.
    """
    spark = chunks.sparkSession
    told = manifest.read(spark, path)
    chunks = written(chunks, "chunks")
    parts = {
        "books": chunks.groupBy("book_name").agg(F.count("*").alias("n_chunks"), F.min("chunk_index_global").alias("first")),
        "pairs": timeline.cooccurrence(chunks, canonical, by=("book_name",)),
        "frames": timeline.build(chunks),
    }
    if targets:
        parts |= _profile_parts(written(timeline.met(chunks, targets).withColumnRenamed("chunk_index_global", "at"), "met"))
    for name, rows in parts.items():
        rows.write.parquet(f"{path}/{name}/seg={told['next']}")
    manifest.commit(spark, path, told | {"version": told["version"] + 1, "next": told["next"] + 1, "segments": [*told["segments"], told["next"]]})


def remove(books: DataFrame, path: str) -> None:
    """Takes out the books of ``books`` (book_name) that have arrived so far; they may arrive again."""
    spark = books.sparkSession
    told = manifest.read(spark, path)
    books.select("book_name").distinct().write.parquet(f"{path}/removals/seg={told['next']}")
    manifest.commit(spark, path, told | {"version": told["version"] + 1, "next": told["next"] + 1, "removals": [*told["removals"], told["next"]]})


def vacuum(spark: SparkSession, path: str) -> list[str]:
    told = manifest.read(spark, path)
    return manifest.vacuum(spark, path, {part: set(told["segments"]) for part in PARTS} | {"removals": set(told["removals"])})


def read(spark: SparkSession, path: str, part: str, version: int | None = None) -> DataFrame:
    """Rows of a part, of the books that are there in a version (the latest). There has to be a segment."""
    told = manifest.read(spark, path, version)
    rows = spark.read.option("basePath", f"{path}/{part}").parquet(*(f"{path}/{part}/seg={s}" for s in told["segments"]))
    if told["removals"]:
        gone = spark.read.option("basePath", f"{path}/removals").parquet(*(f"{path}/removals/seg={s}" for s in told["removals"])).groupBy("book_name").agg(F.max("seg").alias("gone"))
        rows = rows.join(gone, "book_name", "left").where("gone is null or gone < seg").drop("gone")
    return rows.drop("seg")


def cooccurrence(spark: SparkSession, path: str, **options) -> DataFrame:
    """As ``timeline.cooccurrence`` of all chunks."""
    names = ("same_chunk", "same_chapter", "nearby_chunks")
    return read(spark, path, "pairs", **options).groupBy("left", "right").agg(*(F.sum(n).alias(n) for n in names))


def frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """As ``timeline.build`` of all chunks: the places are renumbered over the books that are there, in their order."""
    books = running(read(spark, path, "books", **options), ["book_name"], {"up_to": F.col("n_chunks")})
    shift = books.select("book_name", (F.col("up_to") - F.col("n_chunks") + 1 - F.col("first")).alias("_shift"))
    rows = read(spark, path, "frames", **options)
    return rows.join(shift, "book_name").withColumn("chunk_index_global", F.col("chunk_index_global") + F.col("_shift")).select(*rows.columns)


def profiles(spark: SparkSession, path: str, **options) -> DataFrame:
    """As ``timeline.profiles`` of all chunks."""
    first = F.min(F.struct("book_name", "at", "chunk_id", "chapter_id"))
    out = read(spark, path, "mentions", **options).groupBy("character").agg(F.sum("n").alias("mention_count"), first.alias("x")).select("character", "mention_count", F.col("x.chunk_id").alias("first_mention_chunk"), F.col("x.chapter_id").alias("first_mention_chapter"))
    w = W.partitionBy("character").orderBy(F.desc("score"), "book_name", "at")
    dense = read(spark, path, "dense", **options).withColumn("r", F.row_number().over(w)).where("r <= 8")
    out = out.join(timeline.listed(dense, "chunk_id", "high_signal_chunks"), "character", "left")
    merged = read(spark, path, "values", **options).groupBy("character", "kind", "v").agg(F.sum("n").alias("n"), F.min(F.struct("book_name", "at", "p")).alias("seen"))
    best = merged.withColumn("r", F.row_number().over(W.partitionBy("character", "kind").orderBy(F.desc("n"), "seen", "v"))).where("r <= 12")
    for kind in timeline.PROFILE_LISTS:
        out = out.join(timeline.listed(best.where(F.col("kind") == kind), "v", kind), "character", "left")
    return out
