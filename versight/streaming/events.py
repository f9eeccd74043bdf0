"""Structured streams over events and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versight.operators import ingest

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, *, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    reader = spark.readStream.schema(EVENTS)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def windowed_counts(events: DataFrame, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total) by event time; state is dropped when the watermark passes a window's end."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    by = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return by.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_chunks(books: DataFrame, **options) -> DataFrame:
    """Annotated chunks of streamed (book_name, text) rows, each book one chapter; stateless, so any output mode fits."""
    chapters = books.select("book_name", F.lit(1).alias("chapter_index"), "text")
    return ingest.annotate(ingest.build_chunks(chapters, global_index=False), **options)
