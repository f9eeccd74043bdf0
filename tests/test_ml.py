"""Folds, thresholds and one model on a tiny frame."""

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, VectorAssembler

from versight.operators import ml, timeline


def test_folds_and_scores(spark):
    rows = [(i, "B", "Faria", None, ("he escaped the prison at night" if i % 2 else "she stayed in the house") + f" {i}", i % 2) for i in range(12)]
    df = ml.frame(spark.createDataFrame(rows, "id long, book_name string, character string, caption string, content string, label int"))
    cut, k = ml.folds(df)
    assert k == 5 and cut.count() == 12 and cut.groupBy("fold").count().count() == 5
    words = [CountVectorizer(inputCol="words", outputCol="features")]
    scored = ml.out_of_fold(df.where("id < 4"), ml.text_models()["complement_nb"], stages=words)
    assert sorted(r.id for r in scored.collect()) == [0, 1, 2, 3]


def test_threshold(spark):
    s = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.35, 0), (0.8, 1)], "score double, label int")
    assert tuple(ml.tune_threshold(s).first()) == (0.4, 1.0)


def test_term_weights_are_sublinear_and_whole(spark):
    rows = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a", "c"]), (3, []), (4, None)], "id int, t array<string>")
    model = ml.TermWeights("t", "x").fit(rows)
    number = {r.term: r.number for r in model.table.collect()}
    assert sorted(number.values()) == [0, 1, 2] and set(number) == {"a", "b", "c"}
    got = {r.id: r.x for r in model.transform(rows.unionByName(spark.createDataFrame([(5, ["zzz", "b"])], rows.schema))).collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    a, b = (1 + math.log(2)) * idf(2), idf(1)
    norm = math.hypot(a, b)
    assert abs(got[1][number["a"]] - a / norm) < 1e-9 and abs(got[1][number["b"]] - b / norm) < 1e-9
    assert got[3].numNonzeros() == got[4].numNonzeros() == 0 and abs(got[5][number["b"]] - 1) < 1e-9


def test_training_picks_the_best_model(spark):
    rows = spark.createDataFrame([(i, float(i in (2, 5)), int(i in (2, 5))) for i in range(8)], "id long, good double, label int")
    made = ml.train(rows, {"one": LogisticRegression(weightCol="weight", maxIter=5)}, stages=[VectorAssembler(inputCols=["good"], outputCol="features")])
    assert made["name"] == "one" and made["reports"][0]["macro_f1"] == 1.0
    assert all(r.label == ("contradict" if r.id in (2, 5) else "consistent") for r in ml.predict(made, rows).collect())


def test_meta_features(spark):
    examples = spark.createDataFrame([("1", "SRC0", "Faria", None, "In 1815 Faria met Noirtier in London with a letter."), ("2", "none", "Nobody", None, "nothing")], "id string, book_name string, character string, caption string, content string")
    chunks = spark.createDataFrame([("c1", "src0", "ch", 1, 1, "Faria went to London in 1815 and escaped", ["Faria"], ["escape"], 3.0)], "chunk_id string, book_name string, chapter_id string, chunk_index_global long, chunk_index_in_chapter int, text string, character_mentions array<string>, event_mentions array<string>, plot_density_score double")
    profiles, graph = timeline.profiles(chunks, ["Faria"]), timeline.cooccurrence(chunks)
    constraints = timeline.constraint_features(examples, profiles, graph, chunks)
    rules = timeline.rule_scores(examples, spark.createDataFrame([("Faria", "d", ["met", "london"])], "character string, description string, patterns array<string>"), spark.createDataFrame([], "character string, term string"))
    scores = spark.createDataFrame([("1", 0.7)], "id string, score double")
    got = {r.id: r for r in ml.meta_features(examples, constraints, profiles, rules, scores=scores).collect()}
    assert len(got["1"]) == 1 + 16 + 18
    one, two = got["1"], got["2"]
    assert (one.supervised_score_contradict, one.constraint_hard_hits, one.constraint_risk_score, one.target_character_hit) == (0.7, 1.0, 0.5, 1.0)
    assert (one.num_dates, one.num_locations, one.num_secondary_anchors, one.missing_secondary_anchor_count, one.first_meeting_conflict_score) == (1.0, 1.0, 1.0, 1.0, 1.0)
    assert one.claimed_date_mentioned_near_target == one.claimed_location_mentioned_near_target == 1.0
    # one chunk is the whole corpus: each shared token counts ln(1 + 0.5 / 1.5) * 2.5 / 2.5
    assert abs(one.support_query_max_score - round(3 * math.log(1 + 0.5 / 1.5), 6)) < 1e-6
    assert one.support_minus_contradiction_score == one.support_query_max_score - one.contradiction_query_max_score
    assert all(v == 0 for v in tuple(two)[1:])


def test_quantiles_and_thresholds_of_many_scores(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    scores, labels = rng.integers(0, 5000, 4000) / 5000, rng.integers(0, 2, 4000)
    df = spark.createDataFrame([(float(s), int(x)) for s, x in zip(scores, labels, strict=True)], "score double, label int").repartition(5)
    by = df.groupBy("score").count()
    assert np.allclose(ml.quantiles(by, "score", "count", 100), np.quantile(scores, np.arange(101) / 100))

    def macro(t):
        said = scores >= t
        f = lambda tp, pp, ap: 2 * tp / (pp + ap) if pp + ap else 0.0
        return (f((said & (labels == 1)).sum(), said.sum(), (labels == 1).sum()) + f((~said & (labels == 0)).sum(), (~said).sum(), (labels == 0).sum())) / 2

    cand = sorted(set(np.quantile(scores, np.arange(101) / 100)))
    best = max(cand, key=lambda t: (macro(t), -t))
    got = ml.tune_threshold(df).first()
    assert abs(got.threshold - best) < 1e-9 and abs(got.macro_f1 - macro(best)) < 1e-12
    high = ml.tune_threshold(df, least_recall=0.95).first()
    assert (labels[scores >= high.threshold] == 1).sum() >= 0.95 * labels.sum()
    assert ml.tune_threshold(df.limit(0)).collect() == []


LATER = """
import json, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file:///tmp/versight-shared").config("spark.sql.warehouse.dir", {path!r} + "/w").getOrCreate()
from versight.operators import ml
made = ml.load({path!r} + "/saved")
rows = spark.read.parquet({path!r} + "/rows")
print("FOUND", json.dumps([made["name"], made["threshold"], made["scores"].count(), sorted([r.id, r.score, r.label] for r in ml.predict(made, rows).collect())]))
"""


def test_artifacts_are_loaded_by_a_later_session(spark, tmp_path):
    """Text features with their vocabularies and a fitted model: saved here, loaded by a new driver, equal scores."""
    import json
    import subprocess
    import sys
    from pathlib import Path

    said = ["he escaped the prison at night", "she stayed in the quiet house", "they fled to the coast", "nobody left the old house"]
    rows = [(str(i), f"B{i % 2}", "Faria", None, f"{said[i % 4]} {i}", i % 2) for i in range(12)]
    df = ml.frame(spark.createDataFrame(rows, "id string, book_name string, character string, caption string, content string, label int"))
    df.write.parquet(f"{tmp_path}/rows")
    made = ml.train(df, {"one": LogisticRegression(weightCol="weight", maxIter=5)})
    ml.save(made, f"{tmp_path}/saved")
    expected = sorted([r.id, r.score, r.label] for r in ml.predict(made, df).collect())
    again = ml.load(f"{tmp_path}/saved")
    assert sorted([r.id, r.score, r.label] for r in ml.predict(again, df).collect()) == expected
    assert again["reports"] == made["reports"]
    code = LATER.format(repo=str(Path(__file__).parent.parent), path=str(tmp_path))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=tmp_path)
    found = json.loads(out.stdout.split("FOUND ")[1])
    assert found[:3] == ["one", made["threshold"], 12] and [x[::2] for x in found[3]] == [x[::2] for x in expected]
    assert all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(found[3], expected, strict=True))


def test_buckets(spark, tmp_path):
    """A lookup reads its bucket, and a join doesn't shuffle the table."""
    df = spark.range(1000).selectExpr("concat('t', id) AS term", "cast(id AS int) AS number", "id * 1.0D AS idf")
    ml.write_bucketed(df, f"{tmp_path}/b", by="term", buckets=8)
    back = ml.read_bucketed(spark, f"{tmp_path}/b", "term STRING, number INT, idf DOUBLE", by="term", buckets=8)
    assert sorted(back.collect()) == sorted(df.collect())
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else pruned too, but not told
    one = back.where("term = 't7'")
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert one.count() == 1 and "SelectedBucketsCount: 1 out of 8" in plan
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    joined = back.hint("merge").join(spark.range(50).selectExpr("concat('t', id) AS term").repartition(8, "term"), "term")
    assert joined.count() == 50 and joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_frame_of_any_text(spark):
    texts = ["ab", "abc", "Été à la mer", "a\nb\r\nc", "\U0001f642x\U0001f642yz", "", None, "x" * 50_000]
    df = spark.createDataFrame([(i, "B", None, None, t) for i, t in enumerate(texts)], "id int, book_name string, character string, caption string, content string")
    for r in ml.frame(df).collect():
        low = ("B" + (f" {texts[r.id]}" if texts[r.id] else "")).lower()
        assert r.chars == [low[i : i + n] for n in (3, 4, 5) for i in range(len(low) - n + 1)]
