"""Runs of the whole pipeline, and sweeps over its features."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from versight.functions.store import written
from versight.operators import planning, rerank as rr, retrieval, verify
from versight.sources import io

OFF = {"lexical": False, "semantic": False, "character": False, "event": False, "timeline": False}
#: Name -> (parts that are on, families, timeline queries, re-ranking, note).
CONFIGS = {
    "lexical_only": (("lexical",), False, False, False, "BM25 only."),
    "semantic_only": (("semantic",), False, False, False, "Hashed vectors only."),
    "lexical_plus_semantic": (("lexical", "semantic"), False, False, False, "BM25 and vectors."),
    "plus_character_scoring": (("lexical", "semantic", "character"), False, False, False, "And mentions of the character."),
    "plus_event_scoring": (("lexical", "semantic", "character", "event"), False, False, False, "And event types."),
    "plus_contradiction_families": (("lexical", "semantic", "character", "event"), True, False, False, "And the families' and states' queries."),
    "plus_timeline_features": (("lexical", "semantic", "character", "event", "timeline"), True, True, False, "And timeline queries and cues."),
    "plus_reranker": (("lexical", "semantic", "character", "event", "timeline"), True, True, True, "And heuristic re-ranking."),
}


def signals(found: DataFrame, plans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Retrieved chunks with what re-ranking and diagnostics read; neighbours carry no mentions."""
    extra = found.join(plans.select("example_id", "claim_id", "character", "keywords", "expected_event_types", "incompatible_event_types"), ["example_id", "claim_id"])
    none = F.expr("cast(array() as array<string>)")
    own = lambda c: F.when(F.col("source") == "retrieval", F.col(f"_{c}")).otherwise(none).alias(c)
    marks = chunks.select("chunk_index_global", F.col("character_mentions").alias("_character_mentions"), F.col("event_mentions").alias("_event_mentions"), (F.col("plot_density_score") / 50.0).alias("_density"))
    extra = extra.join(marks, "chunk_index_global")
    return extra.select(*(c for c in extra.columns if not c.startswith("_")), own("character_mentions"), own("event_mentions"), F.when(F.col("source") == "retrieval", F.least(F.col("_density"), F.lit(1.0))).otherwise(0.0).alias("density"))


def run(examples: DataFrame, chunks: DataFrame, *, max_claims: int = 6, max_families: int = 4, k: int = 10, flags: dict[str, bool] | None = None, families: bool = True, timeline: bool = True, rerank: bool = True, verifier=None, mode: str = "hybrid", plans: DataFrame | None = None, best: DataFrame | None = None, **models) -> dict[str, DataFrame]:
    """plans, families, retrieved, verdicts, summary and decisions of annotated chunks. ``verifier(retrieved, plans)`` gives verdicts.

    ``plans`` and ``best`` (of ``retrieval.best_chunks``) may be given where they are known.
    """
    plans = written(planning.plan_claims(examples, max_claims=max_claims), "plans") if plans is None else plans
    fams = planning.families(plans)
    work = planning.work_items(plans, fams, max_families=max_families, use_families=families, use_timeline=timeline)
    top = retrieval.best_chunks(work, chunks, k, flags=flags) if best is None else best
    found = written(signals(retrieval.completed(top, work, chunks), plans, chunks), "retrieved")
    found = rr.rerank_evidence(found, "heuristic" if rerank else "off")
    found = written(found, "reranked") if rerank else found
    verdicts = written((verifier or verify.verify)(found, plans), "verdicts")
    summary = written(verify.aggregate(verdicts), "summary")
    return {"plans": plans, "families": fams, "work": work, "retrieved": found, "verdicts": verdicts, "summary": summary, "decisions": verify.decide(summary, mode=mode, **models)}


#: Channels of the queries that are asked without families and timeline, and those that these add.
ALWAYS, WITH_FAMILIES, WITH_TIMELINE = ("support_claim_query", "support_keyword_query"), ("contradiction_family_query", "incompatible_state_query"), ("timeline_sensitive_query",)


def best_of_all(examples: DataFrame, chunks: DataFrame, configs=CONFIGS, *, max_claims: int = 6, max_families: int = 4, k: int = 10) -> dict[str, DataFrame]:
    """plans, and best: the best chunks of each configuration (``variant``), all scored in one pass over the chunks."""
    plans = written(planning.plan_claims(examples, max_claims=max_claims), "plans")
    work = planning.work_items(plans, planning.families(plans), max_families=max_families)
    variants = {name: (OFF | dict.fromkeys(parts, True), ALWAYS + WITH_FAMILIES * families + WITH_TIMELINE * timeline) for name, (parts, families, timeline, _, _) in configs.items()}
    return {"plans": plans, "best": retrieval.best_chunks(work, chunks, k, variants=variants)}


def ablate(examples: DataFrame, chunks: DataFrame, gold: DataFrame | None = None, *, configs=CONFIGS, fail_fast: bool = False, **options) -> DataFrame:
    """(config, status, num_examples, accuracy, macro_f1, notes), a row for each configuration, in order.

    Metrics need gold labels (id, label) for all examples that get one. A configuration that
    raises is reported as failed; with ``fail_fast`` the sweep ends there. Claims are planned once, and the chunks are read once
    for the best of all configurations.
    """
    rows, known = [], {}
    for name, (parts, families, timeline, rerank, note) in configs.items():
        try:
            known = known or best_of_all(examples, chunks, configs, **{k: v for k, v in options.items() if k in ("max_claims", "max_families", "k")})
            made = run(examples, chunks, flags=OFF | dict.fromkeys(parts, True), families=families, timeline=timeline, rerank=rerank, plans=known["plans"], best=known["best"].where(F.col("variant") == name).drop("variant"), **options)
            labels = written(made["decisions"].select(F.col("example_id").alias("id"), F.col("predicted_label").alias("label")), "labels")
            found = verify.metrics(verify.align(labels, gold, mode="subset")).first() if gold is not None else None
            rows.append((name, "ok", labels.count(), found and found.accuracy, found and found.macro_f1, note))
        except Exception as e:  # a sweep reports what failed
            rows.append((name, "failed", 0, None, None, f"{note} FAILED: {e}"[:500]))
            if fail_fast:
                break
    return examples.sparkSession.createDataFrame(rows, "config string, status string, num_examples long, accuracy double, macro_f1 double, notes string")


def save(results: DataFrame, folder: str) -> None:
    """ablation_report.md and ablation_metrics.json below ``folder``; a sweep has a row for each configuration."""
    spark = results.sparkSession
    rows = results.collect()
    io.write_document(spark, io.report("Ablation Report", {"Results": spark.createDataFrame(rows, results.schema), "Note": "Metrics need gold labels for all predicted rows."}), f"{folder}/ablation_report.md")
    io.write_document(spark, json.dumps([r.asDict() for r in rows], indent=2, sort_keys=True) + "\n", f"{folder}/ablation_metrics.json")
