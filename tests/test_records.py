"""Files and records: readers and sinks round trip, streams, stores, settings."""

import json

import pytest
from pyspark.sql import functions as F

from versight import lexicons as L
from versight.operators import bm25, ingest, timeline, traces, vectors, verify
from versight.plans import registry
from versight.sources import io
from versight.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chunks(spark):
    return registry.annotated(spark, SF).where("chunk_index_global <= 60")


def test_constraint_index_round_trip(spark, chunks, tmp_path):
    profiles, graph = timeline.profiles(chunks, registry.NAMES), timeline.cooccurrence(chunks, canonical=lambda m: m)
    path = str(tmp_path / "index.json")
    io.write_constraint_index(profiles, graph, path)
    got_profiles, got_graph = io.read_constraint_index(spark, path)
    names = [c.split()[0] for c in io.PROFILE.split(", ")]
    assert sorted(map(repr, got_profiles.select("character", *names).collect())) == sorted(map(repr, profiles.select("character", *names).collect()))
    assert sorted(map(repr, got_graph.select(*graph.columns).collect())) == sorted(map(repr, graph.collect()))


def test_timeline_round_trip(spark, chunks, tmp_path):
    frames = timeline.build(chunks)
    path = str(tmp_path / "timeline")
    io.write_timeline_map(frames, path)
    columns = [c.split()[0] for c in io.FRAME.split(", ")]
    want = sorted(map(repr, frames.select(*columns).collect()))
    assert sorted(map(repr, io.read_timeline(spark, path).select(*columns).collect())) == want
    whole = {}
    for r in frames.select(*columns).collect():
        whole.setdefault(r.character, []).append(r.asDict())
    (tmp_path / "one.json").write_text(json.dumps(whole, indent=2))
    assert sorted(map(repr, io.read_timeline(spark, str(tmp_path / "one.json")).select(*columns).collect())) == want


def test_rules_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "rules.json").write_text(json.dumps({"characters": {"Faria": {"hard_constraints": [{"description": "d", "patterns": ["a", "b"]}], "soft_terms": ["t"]}, "Nobody": None}}))
    hard, soft = io.read_rules(spark, str(tmp_path / "rules.json"))
    assert hard.collect() == [("Faria", "d", ["a", "b"])] and soft.collect() == [("Faria", "t")]
    (tmp_path / ".env").write_text("# note\nA=1\nexport MY_B='yes'\nC=3\n")
    monkeypatch.setenv("C", "4")
    got = io.environment({"A": 0, "B": False, "C": 0.5, "D": "x"}, prefix="MY_", dotenv=str(tmp_path / ".env"))
    assert got == {"A": 1, "B": True, "C": 4.0, "D": "x"}


def test_store_and_matches(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps(x) for x in [
        {"book_name": "B", "chunk_text": "Faria fled the prison", "embedding": [1.0, 0.0], "Faria": 1, "event_escape": 1},
        {"book_name": "B", "chunk_text": "Faria slept in peace", "embedding": [0.0, 1.0], "Faria": 1, "event_escape": 0},
        {"book_name": "C", "chunk_text": "Faria fled too", "embedding": [1.0, 0.0], "Faria": 1, "event_escape": 1},
        {"book_name": "B", "chunk_text": "somebody fled the prison", "embedding": None, "event_escape": 1},
    ]))
    store = io.read_store(spark, str(tmp_path / "s.jsonl"), ("Faria", "event_escape"))
    claims = spark.createDataFrame([("s", 1, "the prison fled", "B", ["Faria"], ["event_escape"], [1.0, 0.0]), ("s", 2, "the prison fled", "B", [], [], None)], "story_id string, claim_id int, claim_text string, book_name string, characters array<string>, event_cols array<string>, embedding array<float>")
    got = {r.claim_id: [(c.chunk_text, c.score) for c in r.claim_chunks] for r in vectors.match(claims, store).collect()}
    assert got[1] == [("Faria fled the prison", 0.75 * 3 + 0.25 + 0.5)]
    assert got[2] == [("Faria fled the prison", 2.25), ("somebody fled the prison", 2.25), ("Faria slept in peace", 0.0)]


def test_embedding_is_optional(spark):
    import pandas as pd

    rows = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r.embedding for r in vectors.embed(rows).collect()] == [None, None]
    assert [r.embedding for r in vectors.embed(rows, lambda t: t.map(lambda x: [float(len(x))])).collect()] == [[2.0], [0.0]]

    def broken(texts):
        raise RuntimeError("no model")

    assert [r.embedding for r in vectors.embed(rows, broken).collect()] == [None, None] and pd is not None


def test_predictions_and_reports(spark, tmp_path):
    examples = spark.createDataFrame([("1", "B", "F"), ("2", "B", "F"), ("3", "B", "F")], "id string, book_name string, character string")
    verdicts = spark.createDataFrame([("1", 1, "CONTRADICTED", "HIGH", 1), ("2", 1, "SUPPORTED", "LOW", 1)], "example_id string, claim_id int, verdict string, confidence string, num_evidence long")
    summary = verify.aggregate(verdicts)
    errors = spark.createDataFrame([("2", "too slow")], "example_id string, error string")
    rows = traces.predictions(examples, summary, verify.decide(summary), errors)
    io.write_predictions(rows, str(tmp_path / "p"))
    back = {r.id: r for r in io.read_predictions(spark, str(tmp_path / "p")).collect()}
    assert tuple(rows.columns) == L.PREDICTION_COLUMNS and len(back) == 3
    assert (back["1"].predicted_label, back["1"].decision_mode, back["1"].decision_score) == ("contradict", "hybrid_verifier_high_confidence", "1.0")
    assert (back["2"].internal_status, back["2"].error) == ("ERROR", "too slow")
    assert (back["3"].predicted_label, back["3"].error, back["3"].decision_mode, back["3"].num_claims) == ("consistent", "No claims were verified.", "error", "0")
    aligned = spark.createDataFrame([("a", "consistent", "contradict"), ("b", "contradict", "contradict")], "id string, actual string, predicted string")
    io.write_confusion(verify.confusion(aligned), str(tmp_path / "c"))
    assert [tuple(r) for r in io.read_table(spark, str(tmp_path / "c")).orderBy("actual").collect()] == [("consistent", 0, 1), ("contradict", 0, 1)]
    assert json.loads(io.metrics_json(verify.metrics(aligned)))["accuracy"] == 0.5
    text = io.report("Report", {"Cells": verify.confusion(aligned), "Note": "fine"})
    io.write_document(spark, text, str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text().startswith("# Report\n\n## Cells\n\n| actual")
    io.write_split(examples.withColumn("is_dev", F.col("id") == "1"), str(tmp_path / "split"))
    assert io.read_table(spark, str(tmp_path / "split" / "dev")).count() == 1 and io.read_table(spark, str(tmp_path / "split" / "train")).count() == 2


def test_trace_round_trip(spark, tmp_path):
    claim = {"claim_plan": {"claim_text": "c"}, "retrieved_chunks": [{"chunk_id": "x", "text": "a  b"}], "verifier_output": {"verdict": "SUPPORTED"}}
    schema = "example_id string, claims array<struct<claim_plan:struct<claim_text:string>,retrieved_chunks:array<struct<chunk_id:string,text:string>>,verifier_output:struct<verdict:string>>>, row_error string"
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in [{"example_id": "1", "claims": [], "row_error": "old"}, {"example_id": "2", "claims": [claim] * 3}, {"example_id": "1", "claims": [claim], "row_error": None}]))
    trace = io.read_trace(spark, str(tmp_path / "t.jsonl"), schema)
    got = {r.example_id: (r.any_supported, r.verifier_failed) for r in traces.trace_features(trace).collect()}
    assert got == {"1": (1.0, 0.0), "2": (1.0, 0.0)}
    assert traces.trace_stats(trace).first().num_supported == 4
    aligned = spark.createDataFrame([("2", "contradict", "consistent"), ("1", "contradict", "contradict")], "id string, actual string, predicted string")
    missed = traces.missed_contradictions(aligned, trace).collect()
    assert [(r.example_id, r.claim, r.previews[0].preview) for r in missed] == [("2", "c", "a b")] * 2


def test_numbers_follow_the_order(spark, tmp_path):
    rows = spark.range(100).repartitionByRange(7, "id").sortWithinPartitions("id")
    assert [r._number for r in io.numbered(rows).orderBy("id").collect()] == list(range(1, 101))
    (tmp_path / "a.txt").write_text("x")
    assert [(r.name, r.bytes) for r in io.list_books(spark, str(tmp_path)).collect()] == [("a.txt", 1)]


def test_streams(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.windowed_counts(events.read_events(spark, str(tmp_path / "in"), files_per_batch=1), late="100 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(repr, spark.table("counts").collect())) == sorted(map(repr, events.windowed_counts(table).collect()))
    spark.createDataFrame([("b", "one two three " * 200)], "book_name string, text string").write.parquet(str(tmp_path / "books"))
    books = spark.readStream.schema("book_name string, text string").parquet(str(tmp_path / "books"))
    q = events.stream_chunks(books).select("chunk_id", "text").writeStream.format("memory").queryName("chunks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.chunk_id for r in spark.table("chunks").collect()) == ["b:ch0001:chunk0001", "b:ch0001:chunk0002"]


def test_compatible_names(spark):
    books = spark.createDataFrame([("b", "Chapter 1\nTHE SEA\nbody")], "book_name string, text string")
    assert [(r.chapter_title, r.text) for r in ingest.split_chapters(F.col("text"), books).collect()] == [("THE SEA", "body")]
    assert books.select(ingest.chunk_words(F.lit("a b c"), 2, 1).alias("c")).first().c == ["a b", "b c"]
    record = ingest.records(ingest.annotate(ingest.build_chunks(ingest.chapters(books)))).first()
    assert record.chunk_id == "b:ch0001:chunk0001" and record.metadata.capitalized_phrase_count == 0
    assert bm25 is not None
