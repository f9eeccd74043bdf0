"""Language-model paths with scripted clients."""

import json

import pytest
from pyspark.sql import functions as F

from versight.operators import answers, planning, verify
from versight.sources import io

PLANS = [("e", 1, "He fled the island"), ("e", 2, "He stayed at home"), ("e", 3, "He met nobody"), ("e", 4, "No chunk here")]
CHUNKS = [("e", 1, 1, "c1", "They say he fled\n the island by night"), ("e", 2, 1, "c2", "he never stayed at home"), ("e", 3, 1, "c3", "he met many")]


@pytest.mark.parametrize(("text", "want"), [
    ('{"a": 1}', {"a": 1}), ('Sure:\n```json\n{"a": "}{"}\n``` ok', {"a": "}{"}), ('{bad} then {"b": [1]} {"c": 2}', {"b": [1]}), ("none", None), (None, None), ('{"a": ', None),
])
def test_find_json(text, want):
    found = answers.find_json(text)
    assert (None if found is None else json.loads(found)) == want
    assert answers.find_json('x [1, {"a": 2}]', "[") == '[1, {"a": 2}]'


def scripted():
    def reply(messages):
        """Valid at once for claim 1, on the retry for claim 2, never for claim 3; confirms only claim 1."""
        text, retried = messages[1]["content"], len(messages) > 2
        say = lambda v, c, q: "Here it is: " + json.dumps({"claim_id": 1, "verdict": v, "evidence": [{"chunk_id": c, "quote": q}], "confidence": "high", "reasoning_short": "x"})
        if "still rule the claim out" in text:
            return say("CONTRADICTED", "c1", "he fled") if "fled" in text else say("SUPPORTED", "c2", "he")
        if "fled" in text:
            return say("contradicted", "c1", "he fled")
        if "never stayed" in text:
            return say("CONTRADICTED", "c2", "never stayed") if retried else "no json"
        raise RuntimeError("down")

    return reply


def test_verify_with_a_client(spark):
    plans = spark.createDataFrame(PLANS, "example_id string, claim_id int, claim_text string")
    chunks = spark.createDataFrame(CHUNKS, "example_id string, claim_id int, rank int, chunk_id string, text string")
    got = {r.claim_id: (r.verdict, r.confidence, r.quote, r.num_evidence, r.justification) for r in answers.verify_with(plans, chunks, scripted()).collect()}
    assert got == {
        1: ("CONTRADICTED", "HIGH", "he fled", 1, None),
        2: ("INSUFFICIENT", "LOW", None, 0, "Contradiction was not confirmed by second pass."),
        3: ("INSUFFICIENT", "LOW", None, 0, "Verifier invalid after retries."),
        4: ("INSUFFICIENT", "LOW", None, 0, "No retrieved chunks were provided."),
    }
    user = answers.verifier_messages(plans, chunks).where("claim_id = 1").first().messages[1].content
    assert user == "claim_id=1\nclaim=He fled the island\nchunks:\n[c1] They say he fled the island by night"
    assert answers.insufficient(plans, "x" * 600).first().justification == "x" * 500


def test_quotes_are_checked(spark):
    chunks = spark.createDataFrame(CHUNKS, "example_id string, claim_id int, rank int, chunk_id string, text string")
    raw = [(1, '{"verdict": "SUPPORTED", "confidence": "LOW", "evidence": [{"chunk_id": "c1", "quote": "he swam"}]}'), (2, '{"verdict": "INSUFFICIENT", "confidence": "LOW", "evidence": [{"chunk_id": "c2", "quote": "never"}]}'), (3, '{"verdict": "SUPPORTED", "confidence": "LOW", "evidence": []}')]
    rows = spark.createDataFrame([("e", i, t) for i, t in raw], "example_id string, claim_id int, response string")
    assert {r.claim_id: (r.valid, r.verdict, r.num_evidence) for r in verify.parse_verdicts(rows, chunks).collect()} == {1: (False, "INSUFFICIENT", 0), 2: (True, "INSUFFICIENT", 0), 3: (False, "INSUFFICIENT", 0)}
    texts = spark.createDataFrame([("e", 1, ["he fled", "b"])], "example_id string, claim_id int, texts array<string>")
    whole = {"claim_id": "1", "verdict": "SUPPORTED", "confidence": "HIGH", "evidence": [{"chunk_id": 0, "quote": "fled"}], "justification": "short"}
    for change, valid in (({}, True), ({"evidence": [{"chunk_id": 2, "quote": "fled"}]}, False), ({"justification": "w " * 41}, False), ({"evidence": []}, False), ({"confidence": None}, False)):
        r = answers.justified(spark.createDataFrame([("e", 1, json.dumps(whole | change))], "example_id string, claim_id int, response string"), texts).first()
        assert r.valid == valid, change


def test_cache_keeps_what_was_asked(spark, tmp_path):
    rows = spark.createDataFrame([(i, [("user", t)]) for i, t in enumerate(["a", "b", "a", "fail"])], "id int, messages array<struct<role:string,content:string>>")
    path = str(tmp_path / "cache")

    def client(messages):
        if messages[0]["content"] == "fail":
            raise ValueError("no")
        return messages[0]["content"].upper()

    ask = lambda c: {r.id: r.response for r in answers.cached_ask(rows, c, path, provider="p", model="m").collect()}
    assert ask(client) == {0: "A", 1: "B", 2: "A", 3: None}
    assert io.read_cache(spark, path).count() == 2
    assert ask(lambda m: "late") == {0: "A", 1: "B", 2: "A", 3: "late"}


def test_planner_falls_back(spark):
    examples = spark.createDataFrame([("1", "B", "Faria", "He died in prison. Nobody came there."), ("2", "B", "Faria", "He escaped the cell at night.")], "id string, book_name string, character string, content string")
    client = lambda m: '[{"claim_id": 1, "claim_text": "He died young"}]' if "Nobody came" in m[0]["content"] else "sorry"
    got = {(r.example_id, r.claim_id): (r.claim_text, r.claim_type) for r in answers.plan_with(examples, client).collect()}
    assert got == {("1", 1): ("He died young", "death_status"), **{(r.example_id, r.claim_id): (r.claim_text, r.claim_type) for r in planning.plan_claims(examples.where("id = '2'")).collect()}}


def test_generated_claims_and_contradictions(spark):
    rows = spark.createDataFrame([("B", "F", "one two", "claim a"), ("B", "F", "three", "claim b")], "book_name string, character string, content string, claim_text string")
    good = json.dumps([{"claim_id": i + 1, "claim_text": "a claim of some length", "keywords": ["k"]} for i in range(3)])
    claims = {r.content: len(r.claims) for r in answers.generate_claims(rows, lambda m: good if "one two" in m[0]["content"] else good.replace('"claim_id": 2', '"claim_id": 5')).collect()}
    assert claims == {"one two": 3, "three": 0}
    against = {r.claim_text: r.contradictions for r in answers.generate_contradictions(rows, lambda m: '["x"]' if "claim a" in m[0]["content"] else "no").collect()}
    assert against["claim a"] == ["x", *["Narrative evidence contradicts the claim that claim a"] * 2]
    assert against["claim b"][0] == "The story shows that the opposite of 'claim b' is true." and len(against["claim b"]) == 3


def test_label_passages(spark):
    rows = spark.createDataFrame([("back", "chunk", [("ev",)]), ("other", "", None)], "backstory string, claim_chunk string, contra_evidence array<struct<evidence:string>>")
    got = {r.backstory: r.result.verdict for r in answers.label_passages(rows, lambda m: '{"verdict": "CONTRADICT", "contradictions": []}' if "chunk\nev" in m[1]["content"] else "?").collect()}
    assert got == {"back": "CONTRADICT", "other": "ERROR"}
    assert rows.select(F.lit(1)).count() == 2


def test_numbered_passages(spark):
    claims = spark.createDataFrame([("e", 1, "He fled"), ("e", 2, "He stayed")], "example_id string, claim_id int, claim_text string")
    passages = spark.createDataFrame([("e", 1, ["a", "he fled by night"]), ("e", 2, ["b"])], "example_id string, claim_id int, texts array<string>")
    said = json.dumps({"claim_id": "1", "verdict": "SUPPORTED", "evidence": [{"chunk_id": 1, "quote": "fled"}], "confidence": "HIGH", "justification": "it says so"})
    client = lambda m: "So: " + said if "[1] he fled by night" in m[1]["content"] else said
    got = {r.claim_id: (r.verdict, r.confidence, r.num_evidence) for r in answers.verify_numbered(claims, passages, client).collect()}
    assert got == {1: ("SUPPORTED", "HIGH", 1), 2: ("INSUFFICIENT", "LOW", 0)}


def test_one_call_a_row(spark, tmp_path):
    """A client that counts, and never answers alike: every path asks once a row and round, and judges the answer that it got."""
    log = str(tmp_path)

    def client(messages):
        import os
        import uuid

        key = uuid.uuid4().hex
        with open(os.path.join(log, key), "w") as f:
            f.write(messages[-1]["content"])
        text = messages[-1]["content"]
        if text.startswith("List at most"):
            return json.dumps([{"claim_id": 1, "claim_text": f"claim {key}"}])
        if text.startswith("Extract"):
            return "Here: " + json.dumps([{"claim_id": i + 1, "claim_text": f"claim number {key}", "keywords": ["a"]} for i in range(3)])
        if text.startswith("Write exactly"):
            return "Sure. " + json.dumps([key] * 3)
        if text.startswith("BACKSTORY"):
            return "Well: " + json.dumps({"verdict": key, "contradictions": []})
        return json.dumps({"claim_id": 1, "verdict": "SUPPORTED", "evidence": [{"chunk_id": "c1", "quote": "he fled"}], "confidence": "HIGH", "reasoning_short": key})

    def calls():
        n = len(list(tmp_path.iterdir()))
        for f in list(tmp_path.iterdir()):
            f.unlink()
        return n

    plans = spark.createDataFrame(PLANS[:1], "example_id string, claim_id int, claim_text string")
    chunks = spark.createDataFrame(CHUNKS[:1], "example_id string, claim_id int, rank int, chunk_id string, text string")
    assert [r.verdict for r in answers.verify_with(plans, chunks, client).collect()] == ["SUPPORTED"] and calls() == 1
    examples = spark.createDataFrame([("x", "b", "c", "long text")], "id string, book_name string, character string, content string")
    planned = answers.plan_with(examples, client)
    assert planned.collect() == planned.collect() and calls() == 1
    made = answers.generate_claims(examples, client)
    assert made.first().claims == made.first().claims and len(made.first().claims) == 3 and calls() == 1
    against = answers.generate_contradictions(spark.createDataFrame([("a claim",)], "claim_text string"), client)
    assert against.first() == against.first() and len(set(against.first().contradictions)) == 1 and calls() == 1
    passages = spark.createDataFrame([("b", "c", [("e",)])], "backstory string, claim_chunk string, contra_evidence array<struct<evidence:string>>")
    labelled = answers.label_passages(passages, client)
    assert labelled.first() == labelled.first() and len(labelled.first().result.verdict) == 32 and calls() == 1
    numbered = spark.createDataFrame([("e", 1, ["he fled"])], "example_id string, claim_id int, texts array<string>")
    answers.verify_numbered(plans, numbered, client, tries=1).collect()
    assert calls() == 1


def test_dispatch_loose_verdicts_and_sample(spark):
    plans = spark.createDataFrame(PLANS, "example_id string, claim_id int, claim_text string").withColumn("keywords", F.array(F.lit("night")))
    chunks = spark.createDataFrame(CHUNKS, "example_id string, claim_id int, rank int, chunk_id string, text string")

    def client(messages):
        text = messages[1]["content"]
        if "fled" in text:
            return 'So: {"verdict": "SUPPORTED", "confidence": "HIGH", "reasoning_short": "seen"}'
        return '{"verdict": "CONTRADICTED"}' if "stayed" in text else "no idea"

    got = {r.claim_id: tuple(r)[2:] for r in answers.verify_loosely(plans, chunks, client).collect()}
    none = "The answer gives no reason."
    assert got == {1: ("SUPPORTED", "HIGH", "c1", None, 1, "seen"), 2: ("CONTRADICTED", "LOW", "c2", None, 1, none), 3: ("INSUFFICIENT", "LOW", None, None, 0, none), 4: ("INSUFFICIENT", "LOW", None, None, 0, none)}
    verdicts = lambda df: {r.claim_id: r.verdict for r in df.collect()}
    assert verdicts(answers.verify_claims(plans, chunks)) == verdicts(verify.verify(chunks, plans))
    assert verdicts(answers.verify_claims(plans, chunks, verifier=lambda found, p: verify.null_verdicts(p))) == dict.fromkeys(range(1, 5), "INSUFFICIENT")
    assert verdicts(answers.verify_claims(plans, chunks, client=scripted()))[1] == "CONTRADICTED"
    rows = spark.createDataFrame([("2", "B", {"1": ["x"]}), ("1", "A", {"2": ["q"], "1": ["p", "r"]})], "id string, char string, contradictions map<string,array<string>>")
    assert answers.sample(rows) == "id=1 char=A\n  claim 1\n    1. p\n    2. r\n  claim 2\n    1. q"
    assert "id=2" in answers.sample(rows, 5) and answers.sample(rows.limit(0)) == ""


def test_error_rows(spark, tmp_path):
    from versight.operators import traces

    aligned = spark.createDataFrame([("10", "consistent", "consistent"), ("9", "contradict", "consistent"), ("8", "contradict", "consistent"), ("7", "consistent", "contradict"), ("x", "contradict", "consistent")], "id string, actual string, predicted string")
    said = spark.createDataFrame([("10", 1, "C", 1, 0, 0), ("9", 2, "U", 0, 0, 2), ("8", 2, "U", 1, 0, 1), ("7", 2, "I", 0, 1, 1)], "id string, num_claims long, internal_status string, num_supported long, num_contradicted long, num_insufficient long")
    rows = traces.error_rows(aligned, said, spark.createDataFrame([("7",), ("x",)], "example_id string"))
    got = {r.id: (r.error_type, r.likely_failure_layer) for r in rows.collect()}
    missed = "retrieval_or_verifier_missed_contradiction"
    assert got == {"10": ("correct", "none"), "9": ("false_negative", "verifier_all_insufficient"), "8": ("false_negative", "missing_trace"), "7": ("false_positive", missed), "x": ("false_negative", missed)}
    io.write_errors(rows, f"{tmp_path}/e")
    back = spark.read.option("header", True).csv(f"{tmp_path}/e")
    assert tuple(back.columns) == traces.ERROR_COLUMNS and sorted(r.id for r in back.collect()) == sorted(got)
