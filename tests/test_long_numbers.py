"""Chunk ids of documents with numbers of more than four digits are those of the SQL; the operators' own stay unique."""

import duckdb
import pytest
from pyspark.sql import functions as F

from versight.operators import ingest
from versight.plans import registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long"))
    said = "that with was from " * 150
    spark.createDataFrame([(i, f"src{i % 2}", "en", said) for i in (3, 9999, 10000, 10001, 123456)], "doc_id long, source string, lang string, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["ing_08_chunk_index", "tml_04_incompatible_events"])
def test_ids_of_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = sorted(tuple(r) for r in registry.QUERIES[name](spark, folder).select(*columns).collect())
    assert got == sorted(want.fetchall()) and got


def test_own_ids_stay_unique(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("source").alias("book_name"), F.col("doc_id").alias("chapter_index"), "text")
    ids = [r.chunk_id for r in ingest.build_chunks(rows, global_index=False).collect()]
    assert len(ids) == len(set(ids)) == 10 and any("ch123456:" in i for i in ids)
