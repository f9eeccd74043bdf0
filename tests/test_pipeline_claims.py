"""The hybrid pipeline takes every claim up to the default of six; compared with brute force on a small fixture."""

import re

import pytest
from pyspark.sql import functions as F

from versight.operators import planning, retrieval, verify
from versight.plans import ablation, registry

ITEMS = {
    0: "The captain sailed north in spring. A lighthouse keeper kept the brass lantern burning. The harbour froze that winter; merchants waited for the thaw.",
    1: "One short note about the old bridge.",
    2: "First sentence of many here. Second sentence of many here. Third sentence of many here. Fourth sentence of many here. Fifth sentence of many here. Sixth sentence of many here. Seventh sentence of many here.",
    3: "tiny",
}
DOCS = {
    1: "the captain sailed north with that crew in spring",
    2: f"that lighthouse keeper kept the brass lantern burning {verify.MARKER}",
    3: "merchants waited for the thaw when the harbour froze that winter",
    4: "nothing that matters",
}


def claims_of(text):
    parts = [re.sub(r"\s+", " ", x).strip() for x in re.split(r"(?<=[.!?])\s+|;\s+", text)]
    usable = [x for x in parts if len(x.split(" ")) >= 3 and len(x) >= 12 and re.search(r"[^\W\d_]", x)]
    return (usable or [text.strip()])[:6]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("claims")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = [(i, t, "en", "web", len(t)) for i, t in DOCS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


WANT = {(str(i), n + 1) for i, t in ITEMS.items() for n in range(len(claims_of(t)))}


def test_hybrid_finds_chunks_for_every_claim(spark, small):
    got = registry.QUERIES["ret_17_hybrid"](spark, small).collect()
    assert {(r.example_id, r.claim_id) for r in got} == WANT and len(WANT) == 12
    # every chunk scores (it mentions the character), so each claim gets all four, each once
    assert sorted((r.example_id, r.claim_id, r.rank) for r in got) == sorted((*c, n) for c in WANT for n in range(1, 5))
    best = {(r.example_id, r.claim_id): r.chunk_id for r in got if r.rank == 1}
    assert [best["0", n] for n in (1, 2, 3, 4)] == [f"web:ch{d:04d}:chunk0001" for d in (1, 2, 3, 3)]


def test_flagship_labels_by_all_claims(spark, small, monkeypatch):
    verdicts = []
    aggregate = verify.aggregate
    monkeypatch.setattr(verify, "aggregate", lambda v: verdicts.append(v) or aggregate(v))
    labels = {r.example_id for r in registry.QUERIES["flagship_pipeline"](spark, small).collect()}
    assert labels == {str(i) for i in ITEMS}
    assert {(r.example_id, r.claim_id) for r in verdicts[0].collect()} == WANT


def test_diagnostics_of_every_claim(spark, small):
    rows = registry.QUERIES["evl_10_diagnostics"](spark, small).collect()
    assert {(r.example_id, r.claim_id): (r.num_retrieved_chunks, r.has_target_character_chunk) for r in rows} == {c: (4, True) for c in WANT}
    assert all((r.has_custody_incompatible_candidate is None) == (r.claim_type != "custody_status") for r in rows)
    m = registry.QUERIES["evl_11_diagnostic_metrics"](spark, small).first()
    assert (m.num_dev_examples, m.num_claims, m.avg_claims_per_example, m.target_character_hit_rate, m.avg_retrieved_chunks_per_claim) == (4, 12, 3.0, 1.0, 4.0)


def test_records_of_a_run(spark, small):
    import json

    rows = {r.example_id: r for r in registry.QUERIES["snk_07_pipeline_trace"](spark, small).collect()}
    assert {k: r.n_claims for k, r in rows.items()} == {str(i): len(claims_of(t)) for i, t in ITEMS.items()}
    record = json.loads(rows["0"].record)
    claim = record["claims"][0]
    assert claim["num_retrieved_chunks"] == 4 and len(claim["verifier_chunk_ids"]) == 4 and claim["retrieved_chunks"][0]["rank"] == 1
    assert claim["prompt_char_estimate"] == len(claim["claim_plan"]["claim_text"]) + sum(map(len, DOCS.values()))
    assert record["final_aggregation"]["predicted_label"] in ("consistent", "contradict")


def test_ablation_sweep(spark, small, tmp_path):
    e, chunks = registry._benchmark_examples(spark, small), registry.annotated(spark, small)
    gold = e.select("id", F.lit("consistent").alias("label"))
    some = {k: ablation.CONFIGS[k] for k in ("lexical_only", "plus_reranker")} | {"broken": None}
    got = [tuple(r)[:4] for r in ablation.ablate(e, chunks, gold, configs={k: v for k, v in some.items() if v}).collect()]
    labels = {r.example_id: r.predicted_label for r in registry.QUERIES["flagship_pipeline"](spark, small).collect()}
    assert [g[:3] for g in got] == [("lexical_only", "ok", 4), ("plus_reranker", "ok", 4)]
    assert got[1][3] == sum(v == "consistent" for v in labels.values()) / 4
    bad = ablation.ablate(e, chunks, gold.limit(0), configs={k: ablation.CONFIGS[k] for k in ("lexical_only", "semantic_only")}, fail_fast=True)
    assert [(r.config, r.status) for r in bad.collect()] == [("lexical_only", "failed")]
    ablation.save(bad, str(tmp_path))
    assert "| lexical_only | failed |" in (tmp_path / "ablation_report.md").read_text() and '"status": "failed"' in (tmp_path / "ablation_metrics.json").read_text()


def scored_by_hand(spark, small, k):
    """Every pair's score with the expressions of the parts, and the best k of each claim."""
    from versight import lexicons as L
    from versight.functions import text as T
    from versight.operators import bm25, planning, retrieval

    chunks = registry.annotated(spark, small)
    plans = planning.plan_claims(registry._benchmark_examples(spark, small))
    items = planning.work_items(plans, planning.families(plans)).withColumn("key", F.struct("example_id", "claim_id", "item_idx"))
    tokens = bm25.query_tokens(items.select("key", F.col("query").alias("text")), key="key")
    lexical = bm25.scores(*bm25.index(chunks, key="chunk_index_global"), tokens, decimals=None).toDF("key", "chunk_index_global", "lexical")
    types = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(retrieval.inferred_types(F.col("query")))
    x = items.crossJoin(chunks.drop("book_name")).join(lexical, ["key", "chunk_index_global"], "left").withColumn("signals", retrieval.chunk_signals(F.col("event_mentions"), F.col("text")))
    event = lambda t: retrieval.event_score(t, F.col("signals"), F.col("event_mentions"), F.col("text"))
    x = x.select("key", "chunk_index_global", F.coalesce("lexical", F.lit(0.0)).alias("l"), T.cosine(T.hashed_embedding(F.col("query"), L.SYNONYMS), T.hashed_embedding(F.col("text"), L.SYNONYMS)).alias("s"), retrieval.character_score(F.col("character"), F.col("character_mentions"), F.col("text")).alias("character"), event(types("event_types")).alias("event"), F.when(F.col("channel").rlike("^(contradiction|incompatible)"), event(types("incompatible_event_types"))).otherwise(0.0).alias("incompatible"), F.least(F.col("plot_density_score") / 50, F.lit(1.0)).alias("density"), retrieval.temporal_cue(F.col("text")).alias("temporal"))
    rows = [r.asDict(recursive=True) for r in x.collect()]
    most = {}
    for r in rows:
        key = tuple(r["key"].values())
        b, s = most.get(key, (0.0, 0.0))
        most[key] = max(b, r["l"]), max(s, r["s"])
    best = {}
    for r in rows:
        key = tuple(r["key"].values())
        b, s = most[key]
        r |= {"bm25": r["l"] / b if b > 0 else 0.0, "semantic": max(r["s"] / s, 0.0) if s > 0 else 0.0}
        total = round(sum(w * r[p] for p, w in L.WEIGHTS.items()), 6)
        if total > 0:
            best.setdefault(key[:2], {}).setdefault(r["chunk_index_global"], []).append((-total, key[2]))
    out = {}
    for claim, found in best.items():
        order = sorted((min(v)[0], min(i for _, i in v), at, min(v)[1]) for at, v in found.items())
        out[claim] = [(at, item, -t) for t, _, at, item in order[:k]]
    return items, chunks, out


def test_matrix_scores_equal_expressions(spark, small):
    from versight.operators import retrieval

    items, chunks, want = scored_by_hand(spark, small, 3)
    got = {}
    for r in retrieval.best_chunks(items, chunks, 3).orderBy("rank").collect():
        got.setdefault((r.example_id, r.claim_id), []).append((r.chunk_index_global, r.item_idx, r.final_score))
    assert set(got) == set(want)
    for claim, rows in want.items():
        assert [x[:2] for x in got[claim]] == [x[:2] for x in rows] and all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got[claim], rows, strict=True))
    assert retrieval.best_chunks(items.limit(0), chunks, 3).count() == 0 and retrieval.best_chunks(items, chunks.limit(0), 3).count() == 0
    one = retrieval.best_chunks(items.where("example_id = '0'"), chunks, 3, strict_characters=True, batch_cells=1).collect()
    assert one and all(r.character_score > 0 for r in one)


def test_all_configurations_in_one_pass(spark, small):
    """The best of every configuration equal those of a run of its own."""
    e, chunks = registry._benchmark_examples(spark, small), registry.annotated(spark, small)
    made = ablation.best_of_all(e, chunks, k=3)
    columns = ("example_id", "claim_id", "item_idx", "channel", "chunk_index_global", "final_score", "rank", *retrieval.SCORES)
    for name, (parts, families, timeline, _, _) in ablation.CONFIGS.items():
        work = planning.work_items(made["plans"], planning.families(made["plans"]), max_families=4, use_families=families, use_timeline=timeline)
        alone = retrieval.best_chunks(work, chunks, 3, flags=ablation.OFF | dict.fromkeys(parts, True))
        found = made["best"].where(F.col("variant") == name)
        assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(map(tuple, alone.select(*columns).collect()), key=repr), name
