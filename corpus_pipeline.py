"""The corpus pipeline: stages that each take the documents that their predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, all but the last with the columns of ``documents``. ``run`` applies them, and
writes what each stage but the last returns to the shared folder, so that a lost executor
costs at most one stage's running tasks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from versight.llm import byte_bpe, decontamination, line_cleaning, ngram_jaccard, personal_data, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and failing lines from the others. No shuffle."""
    return line_cleaning.keep_clean(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies one row: of the smallest id, and of its texts the one with the smallest hash.

    Rows are told apart by id and text, so another text of the same id stays, and of rows that
    repeat both one stays. Documents without an id or without words are in no group and stay.
    """
    h = F.xxhash64("text")
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", h.alias("h"))).alias("key"), "text")
    found = shared.written(ngram_jaccard.near_duplicates(keyed, id_col="key").where("n_shingles > 0 and key is not null"), "groups")
    rows, on = docs.select(*COLUMNS, h.alias("h")), ["doc_id", "h"]
    kept = rows.join(found.where("component_id < key").select("key.*").distinct(), on, "left_anti")
    repeated = shared.written(found.where("component_id = key").groupBy("key").count().where("count > 1").select("key.*"), "repeated")
    if repeated.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(repeated, on, "left_semi").groupBy(*on).agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.join(repeated, on, "left_anti").select(*COLUMNS).unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item. No shuffle."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; all documents stay."""
    return personal_data.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept text, and the digest of what they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("personal_data", redacted),
    ("byte_bpe", encoded),
]

#: Retrieval, bootstrapping and tokenising have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = shared.written(docs, f"pipeline-{name}")
    return docs
