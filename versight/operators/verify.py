"""Verdicts on claims, labels of examples, evaluation and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T

MARKER = "CONTRADICTION_FIXTURE"
CLAIM = ("example_id", "claim_id")


def verify(retrieved: DataFrame, plans: DataFrame) -> DataFrame:
    """Deterministic verdicts: a marker contradicts, two keywords support, else insufficient.

    The first chunk by rank that qualifies is the evidence. The quote is the marker, or the
    surroundings of the first long keyword.
    """
    terms = F.filter("keywords", lambda k: F.length(k) > 3)
    rows = plans.select(*CLAIM, terms.alias("terms")).join(retrieved.select(*CLAIM, "rank", "chunk_id", "text"), list(CLAIM), "left")
    low = F.lower("text")
    marked = F.col("text").contains(MARKER)
    shared = F.size(F.filter("terms", lambda t: low.contains(F.lower(t)))) >= 2
    best = lambda c: F.min_by(F.when(c, F.struct("chunk_id", "text")), F.when(c, F.col("rank")))
    found = rows.groupBy(*CLAIM).agg(F.first("terms").alias("terms"), best(marked).alias("m"), best(shared).alias("s"))
    return found.select(
        *CLAIM,
        F.when(F.col("m").isNotNull(), "CONTRADICTED").when(F.col("s").isNotNull(), "SUPPORTED").otherwise("INSUFFICIENT").alias("verdict"),
        F.when(F.col("m").isNotNull(), "HIGH").when(F.col("s").isNotNull(), "MEDIUM").otherwise("LOW").alias("confidence"),
        F.coalesce("m.chunk_id", "s.chunk_id").alias("evidence_chunk_id"),
        F.when(F.col("m").isNotNull(), MARKER).when(F.col("s").isNotNull(), T.window_around(F.col("s.text"), F.get("terms", F.lit(0)))).alias("quote"),
        F.when(F.col("m").isNotNull() | F.col("s").isNotNull(), 1).otherwise(0).cast("long").alias("num_evidence"),
    )


def null_verdicts(plans: DataFrame) -> DataFrame:
    return plans.select(*CLAIM, F.lit("INSUFFICIENT").alias("verdict"), F.lit("LOW").alias("confidence"), F.lit(None).cast("string").alias("evidence_chunk_id"), F.lit(None).cast("string").alias("quote"), F.lit(0).cast("long").alias("num_evidence"))


QUOTES = "array<struct<chunk_id:string,quote:string>>"
VERDICT_JSON = "struct<claim_id:int,verdict:string,evidence:array<struct<chunk_id:string,quote:string>>,confidence:string,reasoning_short:string>"


def parse_verdicts(raw: DataFrame, retrieved: DataFrame, *, text_col: str = "response") -> DataFrame:
    """JSON answers checked against the chunks: known chunk ids, exact quotes, evidence where it is due.

    The first JSON object of an answer counts, whatever stands around it. ``valid`` is false for
    an answer without one, or that fails a check; INSUFFICIENT needs no evidence and keeps
    none. ``quotes`` has the accepted quotes.
    """
    from versight.operators.answers import lenient_json

    p = raw.select(*CLAIM, F.from_json(lenient_json(F.col(text_col)), VERDICT_JSON).alias("j"))
    p = p.select(*CLAIM, F.upper("j.verdict").alias("v"), F.upper("j.confidence").alias("c"), F.coalesce("j.evidence", F.expr(f"cast(array() as {QUOTES})")).alias("e"))
    quotes = p.select(*CLAIM, F.explode("e").alias("q")).join(retrieved.select(*CLAIM, F.col("chunk_id").alias("_id"), "text"), [*CLAIM], "left").where(F.col("_id") == F.col("q.chunk_id"))
    good = quotes.groupBy(*CLAIM).agg(F.count_if(F.col("text").contains(F.col("q.quote")) & (F.col("q.quote") != "")).alias("good"))
    x = p.join(good, list(CLAIM), "left")
    known = F.coalesce(F.col("v").isin("SUPPORTED", "CONTRADICTED", "INSUFFICIENT") & F.col("c").isin("LOW", "MEDIUM", "HIGH"), F.lit(False))
    ok = known & (F.coalesce("good", F.lit(0)) == F.size("e")) & ((F.col("v") == "INSUFFICIENT") | (F.size("e") > 0))
    kept = F.when(ok & (F.col("v") != "INSUFFICIENT"), F.col("e")).otherwise(F.expr(f"cast(array() as {QUOTES})"))
    return x.select(*CLAIM, ok.alias("valid"), F.when(ok, F.col("v")).otherwise("INSUFFICIENT").alias("verdict"), F.when(ok, F.col("c")).otherwise("LOW").alias("confidence"), F.size(kept).cast("long").alias("num_evidence"), kept.alias("quotes"))


def prompt_chars(rows: DataFrame, *, key: list[str], limit: int = 900, top: int = 6) -> DataFrame:
    """Characters of a verifier's prompt: the first chunks, each cut."""
    return rows.where(F.col("rank") <= top).groupBy(*key).agg(F.sum(F.least(F.length("text"), F.lit(limit))).cast("long").alias("prompt_chars"))


def claim_gate(answer: Column) -> Column:
    up = F.upper(F.trim(answer))
    return F.when(up.startswith("VALID"), "VALID").when(up.startswith("INVALID"), "INVALID").otherwise("AMBIGUOUS")


def aggregate(verdicts: DataFrame, *, binary: bool = True) -> DataFrame:
    """One row per example: a contradiction with evidence that is not weak decides, then support."""
    strong = (F.col("verdict") == "CONTRADICTED") & F.col("confidence").isin("MEDIUM", "HIGH") & (F.col("num_evidence") > 0)
    weight = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MEDIUM", 2).otherwise(1)
    counted = verdicts.groupBy("example_id").agg(
        F.count("*").alias("num_claims"),
        *(F.count_if(F.col("verdict") == v).alias(f"num_{v.lower()}") for v in ("SUPPORTED", "CONTRADICTED", "INSUFFICIENT")),
        F.bool_or(strong).alias("strong"),
        F.array_sort(F.collect_list(F.when(strong, F.col("claim_id")))).alias("contradiction_claim_ids"),
        F.max_by("claim_id", F.when(F.col("num_evidence") > 0, F.struct(weight, "num_evidence", -F.col("claim_id")))).alias("strongest_claim_id"),
        F.bool_or((F.col("verdict") == "CONTRADICTED") & (F.col("confidence") == "HIGH")).alias("high"),
    )
    status = F.when(F.col("strong"), "INCONSISTENT").when(F.col("num_supported") > 0, "CONSISTENT").otherwise("UNKNOWN")
    label = F.when(F.col("strong"), "contradict").when(F.col("num_supported") > 0, "consistent").otherwise("consistent" if binary else "UNKNOWN")
    return counted.select("example_id", status.alias("internal_status"), label.alias("final_label"), "num_claims", "num_supported", "num_contradicted", "num_insufficient", "contradiction_claim_ids", "strongest_claim_id", F.col("high").alias("high_contradiction"))


def decide(labels: DataFrame, *, mode: str = "hybrid", meta: DataFrame | None = None, supervised: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Final labels by cascade. Models give (example_id, score, label), rules (example_id, constraint_risk_score)."""
    x, steps = labels.select("example_id", "final_label", "high_contradiction"), []
    order = {"verifier": (), "rules": ("rules",), "supervised": ("supervised",), "meta": ("meta", "supervised"), "hybrid": ("meta", "supervised", "rules")}[mode]
    given = {"meta": meta, "supervised": supervised, "rules": rules}
    for name in order:
        frame = given[name]
        if frame is None:
            continue
        if name == "rules":
            frame = frame.select("example_id", F.col("constraint_risk_score").alias("score"), F.when(F.col("constraint_risk_score") >= 0.5, "contradict").otherwise("consistent").alias("label"))
        x = x.join(frame.select("example_id", F.col("score").cast("double").alias(f"{name}_score"), F.col("label").alias(f"{name}_label")), "example_id", "left")
        steps.append(name)
    label, how, score = F.col("final_label"), F.lit("verifier" if mode == "verifier" else "verifier_fallback"), F.lit(None).cast("double")
    for name in reversed(steps):
        has = F.col(f"{name}_label").isNotNull()
        label, how, score = F.when(has, F.col(f"{name}_label")).otherwise(label), F.when(has, name).otherwise(how), F.when(has, F.col(f"{name}_score")).otherwise(score)
    if mode == "hybrid":
        hit = F.col("high_contradiction")
        label, how, score = F.when(hit, "contradict").otherwise(label), F.when(hit, "hybrid_verifier_high_confidence").otherwise(how), F.when(hit, 1.0).otherwise(score)
    return x.select("example_id", label.alias("predicted_label"), how.alias("decision_mode"), score.alias("score_contradict"))


def normal_label(label: Column, labels=L.LABELS) -> Column:
    low = F.lower(F.trim(label))
    return F.when(low.isin(*labels), low).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null")))).cast("string"))


def align(predictions: DataFrame, gold: DataFrame, *, mode: str = "exact") -> DataFrame:
    """(id, actual, predicted). ``exact`` and ``subset`` raise when ids don't fit; ``partial`` takes the overlap."""
    p = predictions.select("id", normal_label(F.col("label")).alias("predicted"))
    g = gold.select("id", normal_label(F.col("label")).alias("actual"))
    if mode != "partial":
        extra = p.join(g, "id", "left_anti").select("id").limit(5)
        lost = g.join(p, "id", "left_anti").select("id").limit(5) if mode == "exact" else None
        for what, frame in (("prediction", extra), ("gold", lost)):
            if frame is not None and (ids := [r[0] for r in frame.collect()]):
                raise ValueError(f"{what} ids without a partner: {ids}")
    return g.join(p, "id")


def confusion(aligned: DataFrame, labels=L.LABELS) -> DataFrame:
    """(actual, predicted, n) with zero cells."""
    spark = aligned.sparkSession
    cells = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    return cells.join(aligned.groupBy("actual", "predicted").agg(F.count("*").alias("n")), ["actual", "predicted"], "left").fillna(0, ["n"])


def metrics(aligned: DataFrame, labels=L.LABELS) -> DataFrame:
    """One row: accuracy, precision, recall and F1 of each class, and their means."""
    hit = F.col("actual") == F.col("predicted")
    aggs = [F.count("*").alias("num_examples"), F.count_if(hit).alias("correct")]
    for c in labels:
        aggs += [F.count_if(hit & (F.col("actual") == c)).alias(f"tp_{c}"), F.count_if(F.col("predicted") == c).alias(f"pp_{c}"), F.count_if(F.col("actual") == c).alias(f"ap_{c}")]
    x, out = aligned.agg(*aggs), [F.col("num_examples"), F.coalesce(F.try_divide("correct", "num_examples"), F.lit(0.0)).alias("accuracy")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p = {c: zero(F.try_divide(f"tp_{c}", f"pp_{c}")) for c in labels}
    r = {c: zero(F.try_divide(f"tp_{c}", f"ap_{c}")) for c in labels}
    f = {c: zero(F.try_divide(2 * p[c] * r[c], p[c] + r[c])) for c in labels}
    for name, d in (("precision", p), ("recall", r), ("f1", f)):
        out += [F.round(d[c], 6).alias(f"{name}_{c}") for c in labels]
        out.append(F.round(sum(d.values()) / len(labels), 6).alias(f"macro_{name}"))
    return x.select(*out).withColumn("accuracy", F.round("accuracy", 6))


def id_order(c: str) -> list[Column]:
    """Integers by value, then other ids as text."""
    number = F.col(c).try_cast("long")
    return [number.isNull().asc(), number.asc(), F.col(c).asc()]


def hash_order(key: Column, seed: int = 42) -> Column:
    """The seeded order of ids: their digest, then the id as text."""
    return F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))).alias("h"), key.alias("key"))


def least_by_group(rows: DataFrame, group: str, order: Column, number: DataFrame) -> DataFrame:
    """(group, edge): the ``take``-th least order of each group, by halving ranges of the digest.

    number: (group, take). Rows are only counted by group and the digest's first digits, so
    no task sees a group; the digit's cell that holds the edge is then opened alone.
    """
    cells = rows.select(F.col(group), order.alias("o")).withColumn("cell", F.left("o.h", F.lit(3)))
    counts = cells.groupBy(group, "cell").agg(F.count("*").alias("n"))
    before = counts.withColumn("upto", F.sum("n").over(W.partitionBy(group).orderBy("cell"))).join(number, group)
    edge = before.where("upto >= take and upto - n < take").select(group, "cell", (F.col("take") - F.col("upto") + F.col("n")).alias("k"))
    inside = cells.join(F.broadcast(edge), [group, "cell"]).withColumn("r", F.row_number().over(W.partitionBy(group, "cell").orderBy("o")))
    return inside.where("r = k").select(group, F.col("o").alias("edge"))


def split(rows: DataFrame, *, key: str, label: str, dev_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_dev``: of each label a share, at least one and not all, chosen by a seeded hash.

    The share's last digest is found by counts (``least_by_group``), and rows are compared
    with it where they stand. Keys are taken to be distinct within a label.
    """
    order = hash_order(F.col(key), seed)
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    take = n.select(label, F.least(F.greatest(F.lit(1), F.bround(F.col("n") * dev_size)), F.col("n") - 1).cast("long").alias("take"))
    edge = least_by_group(rows, label, order, take)
    return rows.join(F.broadcast(edge), label, "left").withColumn("is_dev", F.coalesce(order <= F.col("edge"), F.lit(False))).drop("edge")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    """(value, n)."""
    return rows.groupBy(value).agg(F.count("*").alias("n"))


def error_type(actual: Column, predicted: Column) -> Column:
    return F.when(actual == predicted, "correct").when((actual == "contradict") & (predicted == "consistent"), "false_negative").when((actual == "consistent") & (predicted == "contradict"), "false_positive").otherwise("wrong")


def failure_layer(actual: Column, predicted: Column, contradicted: Column, insufficient: Column, claims: Column, traced: Column) -> Column:
    return F.when(actual == predicted, "none").when((contradicted == 0) & (insufficient == claims), "verifier_all_insufficient").when(~traced, "missing_trace").otherwise("retrieval_or_verifier_missed_contradiction")


def cache_report(entries: DataFrame, key: str = "key") -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_distinct(key).alias("unique_keys")).withColumn("calls_avoided", F.col("total") - F.col("unique_keys"))


def cache_misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests that no cache entry answers."""
    return requests.join(cache.select(key), key, "left_anti")


def cache_key(provider: Column, model: Column, temperature: Column, messages: Column) -> Column:
    return F.sha2(F.to_json(F.struct(messages.alias("messages"), model.alias("model"), provider.alias("provider"), temperature.alias("temperature"))), 256)
