"""Claims, contradiction families and retrieval work items as expressions and joins with small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from versight import lexicons as L
from versight.functions import text as T


def sentences(text: Column) -> Column:
    """Sentences that can be claims: three words, twelve characters and a letter at least."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+|;\s+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(parts, lambda s: (F.size(F.split(s, " ")) >= 3) & (F.length(s) >= 12) & s.rlike(r"\p{L}"))


def claim_type(text: Column) -> Column:
    """The first type with a term in the text: one word as a token, several as a substring."""
    low = F.lower(text)
    tokens = F.regexp_extract_all(low, F.lit("([a-z0-9'-]+)"), F.lit(1))
    out = F.lit("generic")
    for name, terms in reversed(L.CLAIM_TERMS.items()):
        hit = F.arrays_overlap(tokens, T.literal_array(terms))
        for t in terms:
            if " " in t:
                hit = hit | low.contains(t)
        out = F.when(hit, name).otherwise(out)
    return out


def _by_type(kind: Column, table: dict, value) -> Column:
    out = value(table["generic"]) if "generic" in table else F.expr("cast(array() as array<string>)")
    for name, entry in table.items():
        if name != "generic":
            out = F.when(kind == name, value(entry)).otherwise(out)
    return out


def _filled(templates, c: Column, b: Column) -> Column:
    return F.array(*(F.replace(F.replace(F.lit(t), F.lit("{c}"), c), F.lit("{b}"), b) for t in templates))


def plan_claims(examples: DataFrame, *, max_claims: int = 6) -> DataFrame:
    """One row per claim: the first usable sentences, or the whole text if there is none."""
    text = F.coalesce(F.col("content"), F.lit(""))
    usable = sentences(text)
    chosen = F.slice(F.when(F.size(usable) > 0, usable).otherwise(F.array(F.trim(F.regexp_replace(text, r"\s+", " ")))), 1, max_claims)
    rows = examples.select("id", "book_name", "character", F.posexplode(chosen).alias("p", "claim_text"))
    return plan_texts(rows)


def plan_texts(rows: DataFrame) -> DataFrame:
    """Plans of claims given as (id, book_name, character, p from 0, claim_text): type, queries and states."""
    c, b, k = F.coalesce("character", F.lit("")), F.coalesce("book_name", F.lit("")), F.col("claim_type")
    rows = rows.select(F.col("id").alias("example_id"), (F.col("p") + 1).alias("claim_id"), "book_name", "character", "claim_text", claim_type(F.col("claim_text")).alias("claim_type"), T.keywords(F.col("claim_text"), L.STOP_WORDS).alias("keywords"))
    generic_support = F.array(F.concat_ws(" ", c, "claim_text"), F.concat_ws(" ", b, c, F.array_join(F.slice("keywords", 1, 6), " ")))
    states = _by_type(k, L.STATES, lambda t: _filled(t, c, b))
    support = generic_support
    for name, templates in L.SUPPORT.items():
        support = F.when(k == name, _filled(templates, c, b)).otherwise(support)
    rows = rows.withColumns({
        "expected_event_types": _by_type(k, L.CLAIM_EVENTS, lambda e: T.literal_array(e[0])),
        "incompatible_event_types": _by_type(k, L.CLAIM_EVENTS, lambda e: T.literal_array(e[1])),
        "incompatible_states": states,
        "support_queries": support,
    })
    against = F.concat(F.lit(""), c, F.lit(" incompatible evidence against claim: "), "claim_text")
    return rows.withColumn("contradiction_queries", F.concat(F.transform("incompatible_states", lambda s: F.concat_ws(" ", b, s)), F.array(against)))


def families(plans: DataFrame) -> DataFrame:
    """One row per claim and contradiction family, in order (family_idx from 0)."""
    c = F.coalesce(F.col("character"), F.lit("the character"))

    def made(name, query: Column, types: Column) -> Column:
        return F.struct(F.lit(name).alias("family_name"), query.alias("query"), types.alias("event_types"))

    direct = made("direct_negation", F.concat(c, F.lit(" evidence directly contradicts: "), "claim_text"), F.array_distinct(F.concat("incompatible_event_types", F.array(F.lit("direct_negation")))))
    more = F.expr("cast(array() as array<struct<family_name:string,query:string,event_types:array<string>>>)")
    for kind, entries in L.FAMILIES.items():
        more = F.when(F.col("claim_type") == kind, F.array(*(made(n, F.replace(F.lit(q), F.lit("{c}"), c), T.literal_array(t)) for n, q, t in entries))).otherwise(more)
    return plans.select("example_id", "claim_id", F.posexplode(F.concat(F.array(direct), more)).alias("family_idx", "f")).select("example_id", "claim_id", "family_idx", "f.*")


def work_items(plans: DataFrame, fams: DataFrame, *, max_families: int = 0, use_families: bool = True, use_timeline: bool = True) -> DataFrame:
    """All retrieval queries of a claim: claim, support, families, states, timeline; item_idx from 0."""
    own = fams.groupBy("example_id", "claim_id").agg(F.array_sort(F.collect_list(F.struct("family_idx", "family_name", "query", "event_types"))).alias("fams"))
    if max_families > 0:
        own = own.withColumn("fams", F.slice("fams", 1, max_families))
    c, none = F.coalesce("character", F.lit("")), F.expr("cast(array() as array<string>)")

    def item(query: Column, channel: str, types: Column, family: Column | None = None) -> Column:
        return F.struct(query.alias("query"), F.lit(channel).alias("channel"), types.alias("event_types"), (family if family is not None else F.lit(None).cast("string")).alias("family_name"))

    parts = [F.array(item(F.col("claim_text"), "support_claim_query", none)), F.transform("support_queries", lambda q: item(q, "support_keyword_query", F.col("expected_event_types")))]
    if use_families:
        parts.append(F.transform("fams", lambda f: item(f["query"], "contradiction_family_query", f["event_types"], f["family_name"])))
        parts.append(F.transform("incompatible_states", lambda s: item(F.concat(c, F.lit(" "), s), "incompatible_state_query", F.col("incompatible_event_types"))))
    if use_timeline:
        parts.append(F.array(item(F.concat(c, F.lit(" before after later timeline "), "claim_text"), "timeline_sensitive_query", T.literal_array(["incompatible_time"]))))
    rows = plans.join(own, ["example_id", "claim_id"], "left").withColumn("fams", F.coalesce("fams", F.expr("cast(array() as array<struct<family_idx:int,family_name:string,query:string,event_types:array<string>>>)")))
    return rows.select("example_id", "claim_id", "book_name", "character", "incompatible_event_types", F.posexplode(F.concat(*parts)).alias("item_idx", "i")).select("example_id", "claim_id", "book_name", "character", "incompatible_event_types", "item_idx", "i.*")


def claims_from_json(text: Column, limit: int = 4) -> Column:
    """Claims of a JSON column; an empty array where it does not parse."""
    return F.slice(F.coalesce(F.from_json(text, "array<struct<claim_id:int,claim_text:string,keywords:array<string>>>"), F.expr("cast(array() as array<struct<claim_id:int,claim_text:string,keywords:array<string>>>)")), 1, limit)


def contradictions_of(text: Column, claim_id: Column) -> Column:
    """The strings of a claim in a JSON map; an empty array if it has none."""
    return F.coalesce(F.element_at(F.from_json(text, "map<string,array<string>>"), claim_id.cast("string")), F.expr("cast(array() as array<string>)"))


def claim_queries(claim: Column) -> Column:
    """The default queries of a claim: its text, and what would contradict it, as array<struct<query_type, query_text>>."""
    one = lambda kind, q: F.struct(F.lit(kind).alias("query_type"), q.alias("query_text"))
    return F.array(one("support", claim), one("contradiction", F.concat(F.lit("Evidence that contradicts: "), claim)))
