"""Hand-computed cases of the analytics operators."""

import re

import pytest
from pyspark.sql import functions as F

from versight.functions import text as T
from versight.operators import anchors, bm25, ingest, planning, rerank, retrieval, timeline, verify


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("n,stop,emit", [(0, 0, 0), (1, 1, 1), (300, 1, 1), (400, 1, 2), (401, 2, 2), (700, 2, 3), (701, 3, 3), (1000, 3, 4)])
def test_chunk_counts(spark, n, stop, emit):
    text = " ".join(["w"] * n)
    assert one(spark, F.size(ingest.chunk_array(F.col("t"))), t=text) == stop
    assert one(spark, F.size(ingest.chunk_array(F.col("t"), tail="emit")), t=text) == emit


def test_tokenise(spark):
    assert one(spark, T.tokenise(F.col("t")), t="He'd met the old abbé, in 1815.") == ["he'd", "met", "the", "old", "abb", "1815"]


def test_bm25_values(spark):
    docs = spark.createDataFrame([(1, "ship ship sea"), (2, "sea coast land wind")], "d long, text string")
    asked = spark.createDataFrame([("a", "ship"), ("b", "sea"), ("c", "ship ship"), ("d", None)], "q string, text string")
    got = {(r[0], r[1]): r[2] for r in bm25.scores(*bm25.index(docs, key="d"), bm25.query_tokens(asked, key="q")).collect()}
    assert got == {("a", 1): 1.037867, ("b", 1): 0.194847, ("b", 2): 0.171309, ("c", 1): 2.075735}


def test_density(spark):
    text = "“Faria escaped,” he said, before night."
    f = one(spark, ingest.density_features(F.col("t")), t=text)
    assert tuple(f) == (1, 2, 2, 1, 3)
    assert one(spark, ingest.density_score(ingest.density_features(F.col("t"))), t=text) == 9.75


def test_chapters(spark):
    book = "front\nChapter 1\nTHE SEA\nfirst body\n\nChapter II: Land\nsecond\nmore\nCHAPTER 3\n\nChapter 4\nplain words here go on\n"
    rows = ingest.chapters(spark.createDataFrame([("b", book), ("c", "no heading"), ("d", "")], "book_name string, text string")).orderBy("book_name", "chapter_index").collect()
    assert [tuple(r) for r in rows] == [("b", 1, "THE SEA", "first body"), ("b", 2, "Land", "second\nmore"), ("b", 3, "Chapter 4", "plain words here go on"), ("c", 1, None, "no heading")]


def test_word_boundaries_know_accents(spark):
    assert one(spark, T.phrase_count(F.col("t"), "abb"), t="abbé abb") == 1


def test_cosine(spark):
    v = lambda *x: F.array(*(F.lit(float(i)) for i in x))
    assert one(spark, F.round(T.cosine(v(1, 2), v(2, 1)), 6), t="") == 0.8
    assert one(spark, T.cosine(v(0, 0), v(1, 1)), t="") == 0.0


@pytest.mark.parametrize("text,kind", [("He died in prison.", "death_status"), ("he was re-arrested and shipped", "custody_status"), ("She will return home soon", "possession_document"), ("Ayrton met Glenarvan at sea", "movement_location"), ("under an assumed name", "identity_alias"), ("nothing at all", "generic")])
def test_claim_type(spark, text, kind):
    assert one(spark, planning.claim_type(F.col("t")), t=text) == kind


def test_lenient_json(spark):
    assert one(spark, F.size(planning.claims_from_json(F.col("t"))), t="oops") == 0
    assert one(spark, planning.contradictions_of(F.col("t"), F.lit(2)), t='{"2": ["a", "b"]}') == ["a", "b"]
    assert one(spark, F.size(planning.claim_queries(F.col("t"))), t="claim") == 2


def test_neighbours_go_to_the_best_parent(spark):
    chunks = spark.createDataFrame([(i, "b", "c", i) for i in range(1, 7)], "chunk_index_global long, book_name string, chapter_id string, chunk_index_in_chapter int")
    top = spark.createDataFrame([("e", 1, 3, "x", 0.8, 1), ("e", 1, 5, "x", 0.6, 2)], "example_id string, claim_id int, chunk_index_global long, channel string, final_score double, rank int")
    got = {r.chunk_index_global: (r.final_score, r.parent, r.rank) for r in retrieval.with_neighbours(top, chunks).collect()}
    assert got == {3: (0.8, None, 1), 5: (0.6, None, 2), 2: (0.52, 3, 3), 4: (0.52, 3, 4), 6: (0.39, 5, 5)}


def test_aggregate(spark):
    v = spark.createDataFrame([("a", 1, "SUPPORTED", "MEDIUM", 1), ("a", 2, "CONTRADICTED", "LOW", 1), ("b", 1, "INSUFFICIENT", "LOW", 0), ("c", 1, "CONTRADICTED", "HIGH", 2)], "example_id string, claim_id int, verdict string, confidence string, num_evidence long")
    got = {r.example_id: (r.internal_status, r.final_label, r.num_contradicted, r.strongest_claim_id) for r in verify.aggregate(v).collect()}
    assert got == {"a": ("CONSISTENT", "consistent", 1, 1), "b": ("UNKNOWN", "consistent", 0, None), "c": ("INCONSISTENT", "contradict", 1, 1)}


def test_verify_and_parse(spark):
    plans = spark.createDataFrame([("a", 1, ["ship", "coast", "sea"]), ("b", 1, ["ship", "coast"]), ("c", 1, ["none"])], "example_id string, claim_id int, keywords array<string>")
    found = spark.createDataFrame([("a", 1, 1, "k1", "the ship at the coast"), ("b", 1, 1, "k2", f"x {verify.MARKER} y")], "example_id string, claim_id int, rank int, chunk_id string, text string")
    got = {r.example_id: (r.verdict, r.confidence, r.evidence_chunk_id, r.quote) for r in verify.verify(found, plans).collect()}
    assert got == {"a": ("SUPPORTED", "MEDIUM", "k1", "the ship at the coast"), "b": ("CONTRADICTED", "HIGH", "k2", verify.MARKER), "c": ("INSUFFICIENT", "LOW", None, None)}
    raw = spark.createDataFrame([("a", 1, '{"claim_id":1,"verdict":"SUPPORTED","confidence":"HIGH","evidence":[{"chunk_id":"k1","quote":"the ship"}]}'), ("b", 1, '{"claim_id":1,"verdict":"SUPPORTED","confidence":"HIGH","evidence":[{"chunk_id":"k2","quote":"absent"}]}'), ("c", 1, "no json")], "example_id string, claim_id int, response string")
    assert {r.example_id: r.valid for r in verify.parse_verdicts(raw, found).collect()} == {"a": True, "b": False, "c": False}


def test_metrics(spark):
    rows = spark.createDataFrame([(1, "consistent", "consistent"), (2, "consistent", "contradict"), (3, "contradict", "contradict"), (4, "contradict", "consistent")], "id long, actual string, predicted string")
    m = verify.metrics(rows).first()
    assert (m.accuracy, m.precision_consistent, m.recall_contradict, m.macro_f1) == (0.5, 0.5, 0.5, 0.5)
    assert {(r.actual, r.predicted): r.n for r in verify.confusion(rows).collect()} == {(a, p): 1 for a in ("consistent", "contradict") for p in ("consistent", "contradict")}


def test_split_sizes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 51 else "b") for i in range(80)], "id long, label string")
    got = verify.split(rows, key="id", label="label").where("is_dev").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"a": 10, "b": 6}


def test_align_checks_ids(spark):
    p = spark.createDataFrame([(1, "Consistent"), (9, "contradict")], "id long, label string")
    g = spark.createDataFrame([(1, "contradict"), (2, "consistent")], "id long, label string")
    with pytest.raises(ValueError):
        verify.align(p, g)
    assert [tuple(r) for r in verify.align(p, g, mode="partial").collect()] == [(1, "contradict", "consistent")]


def test_id_order(spark):
    rows = spark.createDataFrame([("10",), ("9",), ("a",), ("2",)], "id string").orderBy(*verify.id_order("id"))
    assert [r.id for r in rows.collect()] == ["2", "9", "10", "a"]


def test_anchors(spark):
    a = one(spark, anchors.extract(F.col("t"), F.lit("Ayrton")), t="In 1815 Ben Joyce, first mate of the Britannia, escaped from New  Zealand with a map.")
    assert a.target_character == "Tom Ayrton" and a.secondary_characters == ["Tom Ayrton/Ben Joyce"]
    assert (a.dates, a.locations, a.institutions, a.roles, a.named_objects, a.event_types) == (["1815"], ["New Zealand"], ["Britannia"], ["first mate"], ["map"], ["escape_release"])


def test_event_overlap_and_aliases(spark):
    assert one(spark, rerank.event_overlap(F.array(F.lit("death"), F.lit("voyage")), F.array(F.lit("violence")), F.col("t")), t="calm") == 0.5
    assert one(spark, rerank.alias_overlap(F.lit("tom ayrton"), F.array(F.lit("Ayrton")), F.col("t")), t="calm") == 0.5


def test_timeline(spark):
    chunks = spark.createDataFrame([("b:ch1:c1", "b", "b:ch1", 1, 1, "Faria slept.", ["Faria"], []), ("b:ch1:c2", "b", "b:ch1", 2, 2, "Noirtier met Faria.", ["Faria", "Noirtier"], ["public_appearance"])], "chunk_id string, book_name string, chapter_id string, chunk_index_global long, chunk_index_in_chapter int, text string, character_mentions array<string>, event_mentions array<string>")
    frames = timeline.build(chunks)
    assert sorted((r.character, r.event_type, r.confidence) for r in frames.collect()) == [("Faria", "mention", 0.45), ("Faria", "public_appearance", 0.7), ("Noirtier", "public_appearance", 0.7)]
    assert timeline.events_after(frames, "faria", 1).count() == 1
    assert [tuple(r) for r in timeline.cooccurrence(chunks).collect()] == [("Faria", "Noirtier", 1, 1, 2)]


def test_density_against_brute_force(spark):
    from versight.plans.registry import EVENTS, MARKERS, NAMES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    got = rows.select("text", ingest.density_features(F.col("text"), NAMES, EVENTS, MARKERS).alias("f")).collect()
    count = lambda t, ws: sum(len(re.findall(rf"(?<!\w){w}(?!\w)", t, re.I)) for w in ws)
    for r in got:
        assert tuple(r.f)[:3] == (count(r.text, NAMES), count(r.text, [w for ws in EVENTS.values() for w in ws]), count(r.text, MARKERS))
