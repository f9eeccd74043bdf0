"""Records of a run (predictions, traces, diagnostics) and what is computed from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T
from versight.operators import verify as V

CLAIM = ("example_id", "claim_id")


def retrieval_trace(retrieved: DataFrame, plans: DataFrame) -> DataFrame:
    """One record per retrieved chunk: ids, query, channel, scores and the first 240 characters."""
    scores = [c for c in (*(f"{p}_score" for p in L.WEIGHTS), "final_score") if c in retrieved.columns]
    query = F.col("query") if "query" in retrieved.columns else F.lit(None).cast("string")
    return retrieved.join(plans.select(*CLAIM, "claim_text"), list(CLAIM)).select(*CLAIM, "claim_text", query.alias("query"), "channel", "chunk_id", F.struct(*scores).alias("score_breakdown"), F.left("text", F.lit(240)).alias("text_preview"))


def predictions(examples: DataFrame, summary: DataFrame, decisions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The columns of a predictions file, one row per example.

    examples: id, book_name, character. summary is ``verify.aggregate``, decisions
    ``verify.decide``. errors (example_id, error): rows that went wrong part of the way keep
    their label with the status ERROR. Examples without verdicts get the error row:
    consistent, zeros, mode ``error``.
    """
    rows = examples.select("id", "book_name", "character").join(summary.withColumnRenamed("example_id", "id"), "id", "left").join(decisions.withColumnRenamed("example_id", "id"), "id", "left")
    rows = rows.join(errors.select(F.col("example_id").alias("id"), "error"), "id", "left") if errors is not None else rows.withColumn("error", F.lit(None).cast("string"))
    done = F.col("num_claims").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    said = F.coalesce(F.col("error"), F.when(done, "").otherwise("No claims were verified."))
    return rows.select(
        "id", "book_name", "character",
        F.when(done, F.col("predicted_label")).otherwise("consistent").alias("predicted_label"),
        F.when(~done | F.col("error").isNotNull(), "ERROR").otherwise(F.col("internal_status")).alias("internal_status"),
        zero("num_claims"), zero("num_supported"), zero("num_contradicted"), zero("num_insufficient"),
        F.left(said, F.lit(500)).alias("error"),
        F.when(done, F.col("decision_mode")).otherwise("error").alias("decision_mode"),
        F.when(done, F.col("score_contradict")).alias("decision_score"),
    ).select(*L.PREDICTION_COLUMNS)


def pipeline_trace(examples: DataFrame, plans: DataFrame, families: DataFrame, retrieved: DataFrame, verdicts: DataFrame, made: DataFrame, *, sent: int = 0, chars: int = 900) -> DataFrame:
    """One nested record per example: its fields, its claims with what was retrieved and said, and its prediction.

    ``sent`` is the number of chunks that the verifier sees (0: all). A claim's rows are
    bounded by the top-k, and an example's by its number of claims.
    """
    names = families.groupBy(*CLAIM).agg(F.transform(F.array_sort(F.collect_list(F.struct("family_idx", "family_name"))), lambda f: f["family_name"]).alias("contradiction_families"))
    chunk = F.struct("rank", "chunk_id", "channel", "final_score", "text")
    found = retrieved.groupBy(*CLAIM).agg(F.array_sort(F.collect_list(chunk)).alias("retrieved_chunks"))
    seen = F.slice("retrieved_chunks", 1, sent) if sent > 0 else F.col("retrieved_chunks")
    claims = plans.select(*CLAIM, "claim_text", "claim_type", "keywords").join(names, list(CLAIM), "left").join(found, list(CLAIM), "left").join(verdicts, list(CLAIM), "left")
    claims = claims.withColumn("retrieved_chunks", F.coalesce("retrieved_chunks", F.expr("cast(array() as array<struct<rank:int,chunk_id:string,channel:string,final_score:double,text:string>>)")))
    each = F.struct(
        "claim_id", F.struct("claim_text", "claim_type", "keywords").alias("claim_plan"), "contradiction_families",
        F.size("retrieved_chunks").alias("num_retrieved_chunks"), F.size(seen).alias("num_chunks_sent_to_verifier"), F.transform(seen, lambda c: c["chunk_id"]).alias("verifier_chunk_ids"),
        (F.length("claim_text") + F.aggregate(F.transform(seen, lambda c: F.least(F.length(c["text"]), F.lit(chars))), F.lit(0), lambda a, x: a + x)).alias("prompt_char_estimate"),
        "retrieved_chunks", F.struct("verdict", "confidence", "quote", "num_evidence").alias("verifier_output"),
    )
    by = claims.groupBy("example_id").agg(F.array_sort(F.collect_list(each)).alias("claims"))
    rows = examples.select(F.col("id").alias("example_id"), F.struct(*(c for c in ("id", "book_name", "character", "label", "caption", "content") if c in examples.columns)).alias("example"))
    final = made.select(F.col("id").alias("example_id"), F.nullif("error", F.lit("")).alias("row_error"), "decision_mode", "decision_score", F.struct("predicted_label", "internal_status", "num_claims", "num_supported", "num_contradicted", "num_insufficient").alias("final_aggregation"))
    return rows.join(by, "example_id", "left").join(final, "example_id", "left")


def trace_claims(trace: DataFrame) -> DataFrame:
    """A row for each claim of the trace."""
    return trace.select("example_id", F.explode("claims").alias("c"))


def trace_stats(trace: DataFrame) -> DataFrame:
    """One row: verdicts by kind and what failed, by words in the justification.

    The claims' ``verifier_output`` may have justification; where it has none only verdicts count.
    """
    out = trace_claims(trace).select("c.verifier_output.*")
    said = F.lower(F.coalesce(F.col("justification"), F.lit(""))) if "justification" in out.columns else F.lit("")
    kinds = [F.count_if(F.col("verdict") == v).alias(f"num_{v.lower()}") for v in ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")]
    return out.agg(*kinds, F.count_if(said.contains("json")).alias("json_failures"), F.count_if(said.contains("local llm provider") | said.contains("memory")).alias("local_provider_failures"), F.count_if(said.contains("not confirmed by second pass")).alias("second_pass_downgrades"))


def trace_features(trace: DataFrame) -> DataFrame:
    """Per example, as doubles: any contradicted, any supported, the number insufficient, and whether the row failed."""
    verdicts = F.transform(F.coalesce("claims", F.expr("array()")), lambda c: c["verifier_output"]["verdict"])
    failed = F.coalesce(F.col("row_error"), F.lit("")) != ""
    number = F.size(F.filter(verdicts, lambda v: v == "INSUFFICIENT"))
    return trace.select("example_id", F.array_contains(verdicts, "CONTRADICTED").cast("double").alias("any_contradicted"), F.array_contains(verdicts, "SUPPORTED").cast("double").alias("any_supported"), number.cast("double").alias("num_insufficient"), failed.cast("double").alias("verifier_failed"))


#: Columns of an error file, in their order.
ERROR_COLUMNS = ("id", "gold_label", "predicted_label", "error_type", "num_claims", "internal_status", "num_supported", "num_contradicted", "num_insufficient", "likely_failure_layer")


def error_rows(aligned: DataFrame, predictions: DataFrame, trace: DataFrame) -> DataFrame:
    """A row for each aligned id: labels, kind of error, the counts of its prediction, and the layer that most likely failed.

    predictions: id and the counts of the summary; trace: example_id. A wrong row without a
    contradicted claim whose claims are all insufficient failed in the verifier; else one without a trace can't be told; else
    retrieval or the verifier missed it. Ids without a prediction row have no counts.
    """
    counts = ("num_claims", "internal_status", "num_supported", "num_contradicted", "num_insufficient")
    x = aligned.join(predictions.select("id", *counts), "id", "left").join(trace.select(F.col("example_id").alias("id")).distinct().withColumn("_traced", F.lit(True)), "id", "left")
    silent = (F.col("num_contradicted") == 0) & F.col("num_insufficient").eqNullSafe(F.col("num_claims"))
    layer = F.when(F.col("actual") == F.col("predicted"), "none").when(silent, "verifier_all_insufficient").when(F.col("_traced").isNull(), "missing_trace").otherwise("retrieval_or_verifier_missed_contradiction")
    x = x.withColumns({"gold_label": F.col("actual"), "predicted_label": F.col("predicted"), "error_type": V.error_type(F.col("actual"), F.col("predicted")), "likely_failure_layer": layer})
    return x.select(*ERROR_COLUMNS)


def missed_contradictions(aligned: DataFrame, trace: DataFrame, *, claims: int = 2, chunks: int = 3) -> DataFrame:
    """The first claims of false negatives with previews of their first chunks."""
    rows = aligned.where(V.error_type(F.col("actual"), F.col("predicted")) == "false_negative").select(F.col("id").alias("example_id"))
    each = rows.join(trace, "example_id").select("example_id", F.explode(F.slice("claims", 1, claims)).alias("c"))
    preview = F.transform(F.slice("c.retrieved_chunks", 1, chunks), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), F.trim(F.regexp_replace(F.left(x["text"], F.lit(240)), r"\s+", " ")).alias("preview")))
    return each.select("example_id", F.col("c.claim_plan.claim_text").alias("claim"), F.col("c.verifier_output.verdict").alias("verdict"), preview.alias("previews"))


def _any_hit(text: Column, events: Column, types, terms) -> Column:
    low = F.lower(text)
    hit = reduce(lambda a, b: a | b, (low.contains(t) for t in terms))
    return F.arrays_overlap(F.transform(events, lambda e: F.lower(e)), T.literal_array(types)) | hit


def diagnostics(plans: DataFrame, families: DataFrame, retrieved: DataFrame, *, top: int = 5) -> DataFrame:
    """One row per claim: its plan, what was retrieved for it, and whether that can bear on it.

    retrieved needs character_mentions, event_mentions and the scores besides the ids. The
    custody and death flags are null for claims of another type. Claims without a chunk stay.
    """
    names = families.groupBy(*CLAIM).agg(F.transform(F.array_sort(F.collect_list(F.struct("family_idx", "family_name"))), lambda f: f["family_name"]).alias("contradiction_families"))
    rows = plans.select(*CLAIM, "book_name", "character", F.col("claim_text").alias("claim"), "claim_type", "expected_event_types", "incompatible_event_types").join(names, list(CLAIM), "left")
    scores = [c for c in (*(f"{p}_score" for p in L.WEIGHTS), "rerank_score") if c in retrieved.columns]
    found = retrieved.select(*CLAIM, "rank", "chunk_id", "channel", "final_score", F.struct(*scores).alias("score_breakdown"), "semantic_score", "text", "event_mentions", "character_mentions")
    x = rows.join(found, list(CLAIM), "left")
    low, who = F.lower("text"), F.lower(F.coalesce("character", F.lit("")))
    said, events = F.transform("character_mentions", lambda m: F.lower(m)), F.transform("event_mentions", lambda e: F.lower(e))
    parts = F.transform(F.split(who, "/"), lambda p: F.trim(p))
    target = F.array_contains(said, who) | low.contains(who) | (who.contains("/") & F.exists(parts, lambda p: F.array_contains(said, p) | low.contains(p)))
    wanted = F.transform(F.concat("expected_event_types", "incompatible_event_types"), lambda e: F.lower(e))
    event = F.arrays_overlap(wanted, events) | F.exists(wanted, lambda e: low.contains(e))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    chunk = F.when(F.col("rank") <= top, F.struct("rank", "chunk_id", "channel", "final_score", "semantic_score", "event_mentions", "character_mentions", "score_breakdown", F.left("text", F.lit(260)).alias("preview")))
    flags = {kind: any_(_any_hit(F.col("text"), F.col("event_mentions"), *hits)) for kind, hits in L.INCOMPATIBLE_HITS.items()}
    keys = [*CLAIM, "book_name", "character", "claim", "claim_type", "expected_event_types", "incompatible_event_types", "contradiction_families"]
    out = x.groupBy(*keys).agg(F.count("chunk_id").alias("num_retrieved_chunks"), any_(target).alias("has_target_character_chunk"), any_(event).alias("has_event_matching_chunk"), flags["custody_status"].alias("_custody"), flags["death_status"].alias("_death"), F.array_sort(F.collect_list(chunk)).alias("top_chunks"))
    only = lambda kind, c: F.when(F.col("claim_type") == kind, F.col(c))
    return out.select(*keys, "num_retrieved_chunks", "has_target_character_chunk", "has_event_matching_chunk", only("custody_status", "_custody").alias("has_custody_incompatible_candidate"), only("death_status", "_death").alias("has_death_incompatible_candidate"), "top_chunks")


def diagnostic_metrics(examples: DataFrame, rows: DataFrame, *, semantic_enabled: bool = True) -> DataFrame:
    """One row of counts, means and rates over the diagnostics; a rate over nothing is 0."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    n = lambda kind: F.count_if(F.col("claim_type") == kind)
    scores = F.transform("top_chunks", lambda c: c["semantic_score"])
    made = rows.agg(
        F.count("*").alias("num_claims"),
        rate(F.col("num_retrieved_chunks")).alias("avg_retrieved_chunks_per_claim"),
        rate(F.col("has_target_character_chunk")).alias("target_character_hit_rate"),
        rate(F.col("has_event_matching_chunk")).alias("event_match_hit_rate"),
        F.coalesce(F.try_divide(F.sum(F.size(F.filter(scores, lambda s: s > 0))), F.sum(F.size(scores))), F.lit(0.0)).alias("semantic_nonzero_score_rate"),
        n("custody_status").alias("custody_claims"),
        rate(F.col("has_custody_incompatible_candidate")).alias("custody_incompatible_candidate_rate"),
        n("death_status").alias("death_claims"),
        rate(F.col("has_death_incompatible_candidate")).alias("death_incompatible_candidate_rate"),
    )
    total = examples.agg(F.count("*").alias("num_dev_examples"))
    return made.crossJoin(F.broadcast(total)).withColumn("avg_claims_per_example", F.coalesce(F.try_divide("num_claims", "num_dev_examples"), F.lit(0.0))).withColumn("semantic_enabled", F.lit(semantic_enabled))


def merge_claims(plans: DataFrame) -> DataFrame:
    """One plan per example: its claims in order, the distinct queries of all, and the keywords."""
    claim = F.struct("claim_id", "claim_text", "claim_type", "keywords")
    x = plans.groupBy("example_id", "book_name", "character").agg(F.array_sort(F.collect_list(F.struct("claim_id", claim.alias("claim"), "support_queries", "contradiction_queries", "incompatible_states"))).alias("p"))
    every = lambda c: F.array_distinct(F.flatten(F.transform("p", lambda p: p[c]))).alias(c)
    return x.select("example_id", "book_name", "character", F.transform("p", lambda p: p["claim"]).alias("claims"), every("support_queries"), every("contradiction_queries"), every("incompatible_states"))


def justified_aggregate(verdicts: DataFrame) -> DataFrame:
    """(example_id, final_verdict, per_claim, counts) where a missing confidence counts as MEDIUM.

    A contradiction with evidence that is not weak decides, then support; else UNKNOWN.
    """
    sure = F.coalesce("confidence", F.lit("MEDIUM"))
    strong = (F.col("verdict") == "CONTRADICTED") & sure.isin("HIGH", "MEDIUM") & (F.coalesce("num_evidence", F.lit(0)) > 0)
    x = verdicts.groupBy("example_id").agg(F.bool_or(strong).alias("s"), F.array_sort(F.collect_list(F.struct("claim_id", "verdict", sure.alias("confidence")))).alias("per_claim"), F.count("*").alias("num_claims"), *(F.count_if(F.col("verdict") == v).alias(f"num_{v.lower()}") for v in ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")))
    return x.select("example_id", F.when(F.col("s"), "INCONSISTENT").when(F.col("num_supported") > 0, "CONSISTENT").otherwise("UNKNOWN").alias("final_verdict"), "per_claim", "num_claims", "num_supported", "num_contradicted", "num_insufficient")


def latest_records(trace: DataFrame, order: str) -> DataFrame:
    """The last record of each example, where runs have appended several."""
    w = W.partitionBy("example_id").orderBy(F.desc(order))
    return trace.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def claim_view(retrieved: DataFrame, example_id: str, claim_id: int | None = None) -> DataFrame:
    """What was retrieved for one example's claims, in order, with previews: for a look at a single case."""
    rows = retrieved.where(F.col("example_id") == example_id)
    rows = rows if claim_id is None else rows.where(F.col("claim_id") == claim_id)
    return rows.select(*CLAIM, "rank", "chunk_id", "channel", "final_score", T.preview(F.col("text"), 240).alias("preview")).orderBy(*CLAIM, "rank")
