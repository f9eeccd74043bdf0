"""The kept index against one that is built anew."""

import pytest
from pyspark.sql import functions as F

from versight.functions import manifest
from versight.operators import bm25, bm25_store as store


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(["alpha"] * (i % 4) + ["beta"] * (i % 3) + [f"word{i % 7}", f"own{i}"])) for i in range(60)] + [(100, ""), (101, None)]
    return spark.createDataFrame(rows, "key long, text string")


def tokens(spark):
    return bm25.query_tokens(spark.createDataFrame([(1, "alpha beta alpha"), (2, "word3 own5 nothing"), (3, "")], "q long, text string"), key="q")


def built(docs, spark):
    t = tokens(spark)
    return sorted(tuple(r) for r in bm25.scores(*bm25.index(docs, key="key"), t).collect())


def found(spark, path, **options):
    return sorted(tuple(r) for r in store.search(spark, path, tokens(spark), **options).collect())


def test_append_delete_and_compact_equal_a_new_index(spark, docs, tmp_path):
    path = f"file://{tmp_path}/i"
    store.create(spark, path, buckets=8)
    assert found(spark, path) == []
    store.append(docs.where("key < 20"), path, key="key")
    assert found(spark, path) == built(docs.where("key < 20"), spark)
    store.append(docs.where("key >= 20"), path, key="key")
    assert found(spark, path) == built(docs, spark)
    store.delete(docs.where("key % 5 = 0").select(F.col("key").alias("doc")).union(spark.range(5000, 5003).toDF("doc")), path)
    assert found(spark, path) == built(docs.where("key % 5 <> 0"), spark)
    # a deleted key comes back with another text
    again = spark.createDataFrame([(5, "alpha word3 word3")], "key long, text string")
    store.append(again, path, key="key")
    now = docs.where("key % 5 <> 0").union(again)
    assert found(spark, path) == built(now, spark)
    version = manifest.read(spark, path)["version"]
    store.delete(again.select(F.col("key").alias("doc")), path)
    assert found(spark, path, version=version) == built(now, spark)
    store.compact(spark, path)
    told = manifest.read(spark, path)
    assert len(told["segments"]) == 1 and told["deletes"] == [] and found(spark, path) == built(docs.where("key % 5 <> 0"), spark)
    n = docs.where("key % 5 <> 0")
    assert store.statistics(told)[0] == n.count()
    gone = store.vacuum(spark, path)
    assert len(gone) == 3 * 2 + 2 and found(spark, path) == built(n, spark)


def test_two_writers(spark, docs, tmp_path):
    path = f"file://{tmp_path}/i"
    store.create(spark, path)
    told = manifest.read(spark, path)
    store.append(docs, path, key="key")
    with pytest.raises(Exception, match="exist"):
        manifest.commit(spark, path, told | {"version": 1})


def test_only_the_tokens_buckets_are_read(spark, docs, tmp_path):
    path = f"file://{tmp_path}/i"
    store.create(spark, path, buckets=32)
    store.append(docs, path, key="key")
    told, t = manifest.read(spark, path), tokens(spark).where("token = 'alpha'")
    rows = store.postings(spark, path, t, told)
    files = {r[0] for r in rows.select(F.col("_metadata.file_path")).distinct().collect()}
    assert len(files) == 1
