"""The diagnostics' best chunks of every claim, re-ranked; compared with the reference's sums on a small fixture."""

import re

from versight import lexicons as L
from versight.operators import planning, rerank, verify
from versight.plans import registry

ITEMS = {
    0: "The captain sailed north in spring. He died before the winter came.",
    1: "He was held in a prison cell; a letter was found later.",
}
DOCS = {
    1: "the captain sailed north with that crew in spring",
    2: f"that lighthouse keeper kept the brass lantern burning {verify.MARKER}",
    3: "he escaped from that prison and was later seen free",
    4: "that letter was found after he returned and spoke",
    5: "of that old bridge nothing more was said",
    6: "that crew arrived during a storm and then departed",
    7: "nothing at all",
}


def overlap(wanted, found):
    return len(set(wanted) & set(found)) / len(set(wanted)) if wanted else 0.0


def signalled(types, events, low):
    hits = [t for t in set(types) if t in events or any(c in events for c in L.SIGNALS.get(t, ((t,), (t,)))[0]) or any(w in low for w in L.SIGNALS.get(t, ((t,), (t,)))[1])]
    return len(hits) / len(set(types)) if types else 0.0


def test_best_chunks_after_reranking(spark, tmp_path):
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in DOCS.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    sf = str(tmp_path)
    plans = planning.plan_claims(registry._benchmark_examples(spark, sf))
    claims = {(r.example_id, r.claim_id): r for r in plans.collect()}
    against = {k: list(r.incompatible_event_types) for k, r in claims.items()}
    for f in planning.families(plans).collect():
        against[f.example_id, f.claim_id] += f.event_types
    chunks = {r.chunk_id: r for r in registry.annotated(spark, sf).collect()}
    want = {}
    for r in registry.QUERIES["ret_17_hybrid"](spark, sf).collect():
        key, c = (r.example_id, r.claim_id), chunks[r.chunk_id]
        low, tokens = c.text.lower(), set(re.findall(r"[a-z0-9']{3,}", c.text.lower()))
        events, kind = [e.lower() for e in c.event_mentions], r.channel
        parts = {
            "exact_character": float("that" in low),
            "alias_overlap": float("that" in low),
            "keyword_overlap": overlap(claims[key].keywords, tokens),
            "expected_overlap": signalled(claims[key].expected_event_types, events, low),
            "incompatible_overlap": signalled(against[key], events, low),
            "temporal_overlap": min(len(tokens & set(L.TEMPORAL)) / 2, 1.0),
            "density": min(min(c.plot_density_score / 50, 1.0) / 50, 1.0),
            "source_type": next((v for k, v in (("contradiction_family", 1.0), ("incompatible_state", 0.9), ("support", 0.7), ("timeline", 0.6)) if k in kind), 0.4),
        }
        added = round(sum(rerank.WEIGHTS[k] * v for k, v in parts.items()), 6)
        want.setdefault(key, []).append((-round(r.final_score + added, 6), r.rank, r.chunk_id, added))
    rows = {(r.example_id, r.claim_id): r for r in registry.QUERIES["evl_10_diagnostics"](spark, sf).collect()}
    assert set(rows) == set(claims) == set(want) and {r.claim_type for r in rows.values()} >= {"death_status", "custody_status"}
    moved = 0
    for key, r in rows.items():
        best = sorted(want[key])
        moved += [x[1] for x in best] != sorted(x[1] for x in best)
        assert r.num_retrieved_chunks == len(best) > 5 and [c.rank for c in r.top_chunks] == [1, 2, 3, 4, 5]
        assert [c.chunk_id for c in r.top_chunks] == [x[2] for x in best[:5]], key
        for c, (score, _, _, added) in zip(r.top_chunks, best, strict=False):
            assert abs(c.final_score + score) < 3e-6 and abs(c.score_breakdown.rerank_score - added) < 3e-6
            assert set(c.score_breakdown.asDict()) == {*(f"{p}_score" for p in L.WEIGHTS), "rerank_score"}
            assert c.preview == chunks[c.chunk_id].text[:260] and c.event_mentions == chunks[c.chunk_id].event_mentions
    assert moved
