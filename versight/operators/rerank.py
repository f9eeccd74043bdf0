"""Heuristic re-ranking of retrieved chunks as arithmetic columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T

#: Fixed weights.
WEIGHTS = {"exact_character": 0.22, "alias_overlap": 0.08, "keyword_overlap": 0.16, "expected_overlap": 0.13, "incompatible_overlap": 0.18, "temporal_overlap": 0.08, "density": 0.08, "source_type": 0.05, "proximity": 0.02}


def set_overlap(wanted: Column, found: Column) -> Column:
    w = F.array_distinct(wanted)
    return F.when(F.size(w) > 0, F.least(F.size(F.array_intersect(w, found)) / F.size(w), F.lit(1.0))).otherwise(0.0)


def alias_overlap(name: Column, mentions: Column, text: Column) -> Column:
    parts = F.filter(F.split(F.lower(name), r"[\s/.-]+"), lambda p: F.length(p) > 2)
    said, low = F.transform(mentions, lambda m: F.lower(m)), F.lower(text)
    return F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda p: low.contains(p) | F.array_contains(said, p))) / F.size(parts)).otherwise(0.0)


def event_overlap(types: Column, events: Column, text: Column, signals=L.SIGNALS) -> Column:
    """Share of the distinct event types that a category or a term signals."""
    said = F.transform(events, lambda e: F.lower(e))
    wanted = F.array_distinct(F.transform(types, lambda t: F.lower(t)))

    def table(low: Column) -> Column:
        pairs = []
        for name, (categories, terms) in signals.items():
            hit = F.arrays_overlap(said, T.literal_array(list(dict.fromkeys((name, *categories)))))
            pairs += [F.lit(name), reduce(lambda a, b: a | b, (low.contains(t) for t in terms), hit)]
        return F.create_map(*pairs)

    def counted(low: Column) -> Column:
        return T.let(table(low), lambda table: F.size(F.filter(wanted, lambda t: F.coalesce(F.element_at(table, t), F.array_contains(said, t) | low.contains(t)))))

    hits = T.let(F.lower(text), counted)
    return F.when(F.size(wanted) > 0, F.least(hits / F.size(wanted), F.lit(1.0))).otherwise(0.0)


def source_score(channel: Column) -> Column:
    return F.when(channel.contains("contradiction_family"), 1.0).when(channel.contains("incompatible_state"), 0.9).when(channel.contains("support"), 0.7).when(channel.contains("timeline"), 0.6).otherwise(0.4)


def rerank(retrieved: DataFrame, *, double_density_norm: bool = True) -> DataFrame:
    """Adds rerank_score to the final score and ranks anew within each claim.

    Needs: example_id, claim_id, rank, chunk_id, text, channel, source, final_score, density
    (already divided by 50), character, keywords, character_mentions, event_mentions,
    expected_event_types, incompatible_event_types (the families' types included). Density is
    divided by 50 once more unless ``double_density_norm`` is off.
    """
    text, c = F.col("text"), F.lower(F.coalesce("character", F.lit("")))
    said = F.transform("character_mentions", lambda m: F.lower(m))
    density = F.coalesce(F.col("density"), F.lit(0.0))
    parts = {
        "exact_character": F.when((c != "") & (F.array_contains(said, c) | F.lower(text).contains(c)), 1.0).otherwise(0.0),
        "alias_overlap": alias_overlap(c, F.col("character_mentions"), text),
        "keyword_overlap": set_overlap(F.col("keywords"), T.tokenise(text)),
        "expected_overlap": event_overlap(F.col("expected_event_types"), F.col("event_mentions"), text),
        "incompatible_overlap": event_overlap(F.col("incompatible_event_types"), F.col("event_mentions"), text),
        "temporal_overlap": F.least(F.size(F.array_intersect(T.tokenise(text), T.literal_array(L.TEMPORAL))) / 2.0, F.lit(1.0)),
        "density": F.least(density / 50.0 if double_density_norm else density, F.lit(1.0)),
        "source_type": source_score(F.col("channel")),
        "proximity": F.when(F.col("source") == "neighbor_expansion", 0.4).otherwise(0.0),
    }
    total = reduce(lambda a, b: a + b, (F.lit(w) * parts[k] for k, w in WEIGHTS.items()))
    out = retrieved.withColumn("rerank_score", F.round(total, 6)).withColumn("final_score", F.round(F.col("final_score") + F.col("rerank_score"), 6))
    order = W.partitionBy("example_id", "claim_id").orderBy(F.desc("final_score"), "rank", "chunk_id")
    return out.withColumn("new_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("new_rank", "rank")


def rerank_with_model(retrieved: DataFrame, scorer, *, query_col: str = "query") -> DataFrame:
    """Scores of an injected vectorised model ``scorer(queries, texts) -> Series``, scaled to 0..1 per claim and added."""
    score = F.pandas_udf(scorer, "double")
    w = W.partitionBy("example_id", "claim_id")
    out = retrieved.withColumn("raw", score(F.col(query_col), F.col("text")))
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    out = out.withColumn("rerank_score", F.round(F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(0.0), 6)).drop("raw")
    out = out.withColumn("final_score", F.round(F.col("final_score") + F.col("rerank_score"), 6))
    return out.withColumn("new_rank", F.row_number().over(w.orderBy(F.desc("final_score"), "rank", "chunk_id"))).drop("rank").withColumnRenamed("new_rank", "rank")


def rerank_evidence(retrieved: DataFrame, mode: str = "heuristic", *, scorer=None, query_col: str = "query") -> DataFrame:
    """By ``mode``: ``off`` leaves the order, ``heuristic``, or ``model`` with an injected scorer."""
    if mode == "off":
        return retrieved
    if mode == "model":
        if scorer is None:
            raise ValueError("the mode model needs a scorer")
        return rerank_with_model(retrieved, scorer, query_col=query_col)
    if mode != "heuristic":
        raise ValueError(f"unknown mode: {mode}")
    return rerank(retrieved)
