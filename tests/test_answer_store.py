"""The kept answers against a dictionary."""

from pyspark.sql import functions as F

from versight.functions import manifest
from versight.operators import answers
from versight.sources import answer_store as store


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, output string")


def test_put_get_compact(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    store.create(spark, path, buckets=8)
    everything = spark.createDataFrame([(f"k{i}",) for i in range(60)] + [(None,)], "key string")
    look = lambda **o: {r.key: r.output for r in store.get(everything, path, **o).collect()}
    assert look() == {} and store.report(spark, path).first() == (0, 0, 0)
    store.put(rows(spark, [(f"k{i}", f"a{i}") for i in range(30)] + [("k1", "a0"), (None, "x"), ("k50", None)]), path)
    want = {f"k{i}": f"a{i}" for i in range(30)} | {"k1": "a0"}
    assert look() == want
    store.put(rows(spark, [(f"k{i}", f"b{i}") for i in range(20, 40)]), path)
    store.put(rows(spark, [(None, "nothing to keep")]), path)
    version = manifest.read(spark, path)["version"]
    want |= {f"k{i}": f"b{i}" for i in range(20, 40)}
    assert look() == want and tuple(store.report(spark, path).first()) == (2, 50, 40)
    store.compact(spark, path)
    assert look() == want and look(version=version) == want and tuple(store.report(spark, path).first()) == (1, 40, 40)
    assert store.vacuum(spark, path) == ["answers/seg=1", "answers/seg=2"] and look() == want


def test_a_lookup_reads_its_buckets_only(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    store.create(spark, path, buckets=32)
    store.put(rows(spark, [(f"k{i}", "x") for i in range(500)]), path)
    found = store._rows(spark, path, manifest.read(spark, path))
    bucket = found.where("key = 'k7'").first().bucket
    assert len(found.inputFiles()) == 32
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = store.get(rows(spark, [("k7", "")]), path)
        assert one.collect() == [("k7", "x")]
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket})" in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_questions_through_the_store(spark, tmp_path):
    """Equal requests are asked once, later ones are answered from the store; failures aren't kept."""
    path, log = f"file://{tmp_path}/c", str(tmp_path)

    def client(messages):
        import uuid

        text = messages[-1]["content"]
        with open(f"{log}/{uuid.uuid4().hex}.call", "w") as f:
            f.write(text)
        if text == "bad":
            raise ValueError
        return text.upper()

    store.create(spark, path)
    ask = lambda texts: {r.id: r.response for r in answers.cached_ask(spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(texts)], f"id int, messages {answers.MESSAGES}"), client, path, provider="p", model="m").collect()}
    assert ask(["a", "a", "b", "bad"]) == {0: "A", 1: "A", 2: "B", 3: None}
    assert len(list(tmp_path.glob("*.call"))) == 3
    assert ask(["b", "c", "bad"]) == {0: "B", 1: "C", 2: None}
    assert len(list(tmp_path.glob("*.call"))) == 5


def test_objects(spark, tmp_path):
    path = f"file://{tmp_path}/o"
    store.create(spark, path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    made = df.select(store.object_key("plan", F.struct("x", "y")).alias("key"), F.to_json(F.struct("x")).alias("output"))
    store.put(made, path)
    assert {r.output for r in store.get(made, path).collect()} == {'{"x":1}', '{"x":2}'}
    other = df.select(store.object_key("other", F.struct("x", "y")).alias("key"))
    assert store.get(other, path).collect() == []
