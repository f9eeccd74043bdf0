"""Timelines, character profiles, co-occurrence and constraint features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T
from versight.functions.store import written
from versight.operators import anchors as A, bm25, planning

LOCATION = r"\b(?:at|in|to|from|near)\s+([A-Z][A-Za-z]*(?:\s+[A-Z][A-Za-z]*)*)"
PHRASE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"


def temporal_markers(text: Column, markers=L.TEMPORAL) -> Column:
    """Markers that are substrings of the text, in the lexicon's order."""
    low = F.lower(text)
    return F.filter(T.literal_array(markers), lambda m: low.contains(m))


def location_markers(text: Column) -> Column:
    found = F.concat(F.regexp_extract_all(text, F.lit(LOCATION), F.lit(1)), F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0)))
    return F.slice(F.array_distinct(found), 1, 12)


def surface_text(text: Column, name: Column) -> Column:
    """The first sentence that has the name, else the text; 320 characters at most."""
    clean = F.trim(text)
    hits = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: F.lower(s).contains(F.lower(name)))
    return F.left(F.coalesce(F.get(hits, F.lit(0)), clean), F.lit(320))


def build(chunks: DataFrame) -> DataFrame:
    """One frame per chunk, character and event; a chunk without events has ``mention``. Chunks may have no global index."""
    at = F.col("chunk_index_global") if "chunk_index_global" in chunks.columns else F.lit(None).cast("long").alias("chunk_index_global")
    events = F.when(F.size("event_mentions") > 0, F.col("event_mentions")).otherwise(F.array(F.lit("mention")))
    rows = chunks.withColumn("character", F.explode("character_mentions")).withColumn("event_type", F.explode(events))
    frame_id = F.concat_ws(":", "chunk_id", T.slug(F.col("character"), "x"), T.slug(F.col("event_type"), "x"))
    return rows.select(frame_id.alias("frame_id"), "book_name", "character", "event_type", surface_text(F.col("text"), F.col("character")).alias("surface_text"), "chunk_id", "chapter_id", at, temporal_markers(F.col("text")).alias("temporal_markers"), location_markers(F.col("text")).alias("location_markers"), F.when(F.col("event_type") == "mention", 0.45).otherwise(0.7).alias("confidence"))


def events_for(frames: DataFrame, character: str) -> DataFrame:
    return frames.where(F.lower("character") == character.lower())


def events_after(frames: DataFrame, character: str, index: int) -> DataFrame:
    return events_for(frames, character).where(F.col("chunk_index_global") > index)


def incompatible_events(frames: DataFrame, wanted: DataFrame, aliases=L.EVENT_ALIASES) -> DataFrame:
    """Frames of the (character, event_type) rows of ``wanted``, with the types that count as them."""
    table = F.create_map(*(x for k, v in aliases.items() for x in (F.lit(k), T.literal_array(v))))
    asked = wanted.select(F.lower("character").alias("_c"), F.explode(F.coalesce(F.element_at(table, F.col("event_type")), F.array("event_type"))).alias("_e")).distinct()
    return frames.join(asked, (F.lower(frames.character) == F.col("_c")) & (F.lower(frames.event_type) == F.lower(F.col("_e"))), "left_semi")


def cooccurrence(chunks: DataFrame, canonical=A.canonical, *, by: tuple[str, ...] = ()) -> DataFrame:
    """(left, right, same_chunk, same_chapter, nearby_chunks) of name pairs, for each value of the columns ``by`` (book_name, chapter_id).

    Nearby pairs take the lesser name from a chunk and the other from at most two chunks
    before or after in the chapter.
    """
    rows = chunks.select("book_name", "chapter_id", "chunk_index_in_chapter", "chunk_id", F.transform("character_mentions", lambda m: canonical(m)).alias("names"))
    rows = written(rows, "names")  # three counts read it, none the texts again

    def pairs(frame: DataFrame, left: str, right: str, name: str) -> DataFrame:
        each = frame.select(*by, F.explode(left).alias("left"), F.col(right).alias("rs"))
        return each.select(*by, "left", F.explode("rs").alias("right")).where("left < right").groupBy(*by, "left", "right").agg(F.count("*").alias(name))

    same = pairs(rows, "names", "names", "same_chunk")
    by_chapter = rows.groupBy("book_name", "chapter_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    chapter = pairs(by_chapter, "names", "names", "same_chapter")
    band = W.partitionBy("book_name", "chapter_id").orderBy("chunk_index_in_chapter").rowsBetween(-2, 2)
    near_rows = rows.withColumn("near", F.array_distinct(F.flatten(F.collect_list("names").over(band)))).withColumn("names", F.array_distinct("names"))
    near = pairs(near_rows, "names", "near", "nearby_chunks")
    return reduce(lambda a, b: a.join(b, [*by, "left", "right"], "full"), (same, chapter, near)).fillna(0, ["same_chunk", "same_chapter", "nearby_chunks"])


def _most_common(rows: DataFrame, values: str, out: str, k: int = 12) -> DataFrame:
    """The k most frequent values of each character; ties go to the one seen first."""
    each = rows.select("character", "chunk_index_global", F.posexplode(values).alias("p", "v"))
    counted = each.groupBy("character", "v").agg(F.count("*").alias("n"), F.min(F.struct("chunk_index_global", "p")).alias("seen"))
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("character").orderBy(F.desc("n"), "seen", "v"))).where(f"r <= {k}")
    return ranked.groupBy("character").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("x")).select("character", F.transform("x", lambda e: e["v"]).alias(out))


#: What a profile lists, and where it is found.
PROFILE_LISTS = {"co_mentioned_characters": "a.secondary_characters", "associated_locations": "a.locations", "associated_roles": "a.roles", "associated_dates": "a.dates", "important_event_types": "event_mentions"}


def met(chunks: DataFrame, targets) -> DataFrame:
    """Chunks with each target that they mention (character) and what a profile lists of their text (a).

    A text is searched once, before the targets are met.
    """
    names, plain = F.array(*(F.lit(t) for t in targets)), F.col("_plain")
    said = F.transform("character_mentions", lambda m: F.lower(A.canonical(m)))
    who = T.let(F.struct(said.alias("said"), F.lower("text").alias("low")), lambda x: F.filter(names, lambda t: F.array_contains(x["said"], F.lower(t)) | x["low"].contains(F.lower(t))))
    hit = chunks.withColumn("_who", who).where(F.size("_who") > 0).withColumn("_plain", T.plain(F.col("text")))
    text = F.col("text")
    found = hit.withColumn("_a", F.struct(A.people_of(text, plain).alias("people"), A.find_terms(text, L.LOCATIONS, plain).alias("locations"), A.years(text).alias("dates"), A.find_terms(text, L.ROLES, plain).alias("roles")))
    found = found.drop("_plain").withColumn("character", F.explode("_who"))
    aim = A.canonical(F.coalesce("character", F.lit("")))
    a = F.struct(aim.alias("target_character"), F.array_except("_a.people", F.array(aim)).alias("secondary_characters"), F.col("_a.locations").alias("locations"), F.col("_a.dates").alias("dates"), F.col("_a.roles").alias("roles"))
    return found.withColumn("a", a).drop("_who", "_a")


def listed(rows: DataFrame, value: str, out: str) -> DataFrame:
    """(character, out): the values of ranked rows (r) in their order."""
    return rows.groupBy("character").agg(F.array_sort(F.collect_list(F.struct("r", F.col(value).alias("v")))).alias("x")).select("character", F.transform("x", lambda e: e["v"]).alias(out))


def profiles(chunks: DataFrame, targets) -> DataFrame:
    """One row per target: first mention, densest chunks, what it is mentioned with."""
    rows = written(met(chunks, targets).select("character", "chunk_index_global", "chunk_id", "chapter_id", "plot_density_score", "event_mentions", "a"), "met")
    base = rows.groupBy("character").agg(F.count("*").alias("mention_count"), F.min_by("chunk_id", "chunk_index_global").alias("first_mention_chunk"), F.min_by("chapter_id", "chunk_index_global").alias("first_mention_chapter"))
    dense = rows.withColumn("r", F.row_number().over(W.partitionBy("character").orderBy(F.desc("plot_density_score"), "chunk_index_global"))).where("r <= 8")
    out = base.join(listed(dense, "chunk_id", "high_signal_chunks"), "character", "left")
    for name, values in PROFILE_LISTS.items():
        out = out.join(_most_common(rows, values, name), "character", "left")
    return out


#: The constraint features, in order.
CONSTRAINTS = (
    "num_secondary_anchors", "num_dates", "num_locations", "num_roles", "target_secondary_same_chunk_count", "target_secondary_same_chapter_count",
    "missing_secondary_anchor_count", "claimed_date_mentioned_near_target", "claimed_location_mentioned_near_target", "claimed_role_mentioned_near_target",
    "unsupported_specific_anchor_score", "contradiction_query_max_score", "support_query_max_score", "support_minus_contradiction_score",
    "first_meeting_conflict_score", "role_mismatch_score", "temporal_mismatch_score", "location_mismatch_score",
)


def contradiction_queries(examples: DataFrame) -> DataFrame:
    """(id, query): the incompatible states and family queries of all claims, or the whole text if there are none."""
    plans = planning.plan_claims(examples)
    states = plans.select(F.col("example_id").alias("id"), F.explode("incompatible_states").alias("query"))
    found = states.unionByName(planning.families(plans).select(F.col("example_id").alias("id"), "query"))
    none = examples.join(found.select("id").distinct(), "id", "left_anti").select("id", F.col("content").alias("query"))
    return found.unionByName(none)


def query_scores(examples: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, kind, best): the highest BM25 score of any query (id, kind, query) of an example over its chunks.

    An example's corpus is its book's chunks that mention its character, or else all of the
    book's; frequencies and lengths are those of this corpus. Examples of one book and
    character share a corpus, which is a set of chunk numbers: the texts are tokenised once.
    """
    who = A.canonical(F.coalesce(F.col("character"), F.lit("")))
    own = examples.select("id", F.struct(F.lower("book_name").alias("b"), F.lower(who).alias("t")).alias("g"))
    said = F.transform("character_mentions", lambda m: F.lower(A.canonical(m)))
    asked = written(bm25.query_tokens(queries.select(F.struct("id", "kind", "query").alias("q"), F.col("query").alias("text")).distinct(), key="q").join(own.select(F.col("id").alias("_id"), "g"), F.col("query.id") == F.col("_id")).select("g", "query", "token", "m"), "asked")
    met = chunks.join(own.select("g").distinct().withColumn("_b", F.col("g.b")), F.lower("book_name") == F.col("_b"))
    corpus = met.select("g", F.col("chunk_index_global").alias("doc"), (F.array_contains(said, F.col("g.t")) | F.lower("text").contains(F.col("g.t"))).alias("hit"))
    whole = corpus.groupBy("g").agg(F.max("hit").alias("any"))
    corpus = written(corpus.join(whole, "g").where("hit or not any").select("g", "doc"), "corpora")
    tf, own_len = bm25.postings(chunks, key="chunk_index_global", asked=asked)
    stats = corpus.join(own_len, "doc").groupBy("g").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = written(corpus.join(tf, "doc"), "corpus-postings")
    df = tf.groupBy("g", "token").agg(F.count("*").alias("df"))
    scored = bm25.scores(tf, df, stats, asked, group="g", decimals=None)
    best = scored.groupBy("query.id", "query.kind").agg(F.round(F.max("score"), 6).alias("best"))
    return examples.select("id").crossJoin(F.broadcast(queries.select("kind").distinct())).join(best, ["id", "kind"], "left").select("id", "kind", F.coalesce("best", F.lit(0.0)).alias("best"))


def constraint_features(examples: DataFrame, profile: DataFrame, graph: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id and the columns ``CONSTRAINTS``): the anchors' counts, hits near the target, best query scores, mismatches.

    examples: id, book_name, character, caption, content.
    """
    asked = examples.select("id", F.lit("support").alias("kind"), F.col("content").alias("query")).unionByName(contradiction_queries(examples).withColumn("kind", F.lit("contradiction")))
    best = query_scores(examples, asked, chunks).groupBy("id").agg(*(F.max(F.when(F.col("kind") == k, F.col("best"))).alias(f"{k}_query_max_score") for k in ("support", "contradiction")))
    return _anchor_features(examples, profile, graph).join(best, "id").withColumn("support_minus_contradiction_score", F.col("support_query_max_score") - F.col("contradiction_query_max_score")).select("id", *CONSTRAINTS)


def _anchor_features(examples: DataFrame, profile: DataFrame, graph: DataFrame) -> DataFrame:
    """The features that come from anchors, profiles and the graph."""
    text = F.concat_ws(" ", "book_name", "character", "caption", "content")
    e = examples.select("id", "content", A.extract(text, F.col("character")).alias("a"))
    pair = e.select("id", F.col("a.target_character").alias("t"), F.explode("a.secondary_characters").alias("s")).select("id", F.least("t", "s").alias("left"), F.greatest("t", "s").alias("right"))
    co = pair.join(graph, ["left", "right"], "left").groupBy("id").agg(F.sum(F.coalesce("same_chunk", F.lit(0))).alias("sc"), F.sum(F.coalesce("same_chapter", F.lit(0))).alias("sh"), F.count_if((F.coalesce("same_chunk", F.lit(0)) == 0) & (F.coalesce("same_chapter", F.lit(0)) == 0)).alias("miss"))
    x = e.join(co, "id", "left").join(profile.select(F.col("character").alias("_c"), "associated_locations", "associated_roles", "associated_dates"), F.col("a.target_character") == F.col("_c"), "left")
    low = lambda c: F.transform(F.coalesce(c, F.expr(A.EMPTY)), lambda v: F.trim(F.regexp_replace(F.lower(v), r"\s+", " ")))
    claimed = {k: F.array_distinct(low(F.col(f"a.{k}"))) for k in ("locations", "roles", "dates")}
    seen = {k: low(F.col(f"associated_{k}")) for k in claimed}
    missing = {k: missing_ratio(claimed[k], seen[k]) for k in claimed}
    near = {k: F.arrays_overlap(claimed[k], seen[k]).cast("double") for k in claimed}
    n = lambda k: F.size(f"a.{k}").cast("double")
    sc, sh, miss = (F.coalesce(c, F.lit(0)).cast("double") for c in ("sc", "sh", "miss"))
    total = n("secondary_characters") + n("locations") + n("roles") + n("dates")
    low_text = F.lower("content")
    meeting = low_text.contains("first") | low_text.contains("met") | low_text.contains("hired")
    return x.select(
        "id",
        n("secondary_characters").alias("num_secondary_anchors"), n("dates").alias("num_dates"), n("locations").alias("num_locations"), n("roles").alias("num_roles"),
        sc.alias("target_secondary_same_chunk_count"), sh.alias("target_secondary_same_chapter_count"), miss.alias("missing_secondary_anchor_count"),
        near["dates"].alias("claimed_date_mentioned_near_target"), near["locations"].alias("claimed_location_mentioned_near_target"), near["roles"].alias("claimed_role_mentioned_near_target"),
        F.when(total > 0, F.least((miss + missing["locations"] + missing["roles"] + missing["dates"]) / total, F.lit(1.0))).otherwise(0.0).alias("unsupported_specific_anchor_score"),
        F.when((n("secondary_characters") > 0) & meeting & (sc == 0) & (sh == 0), 1.0).otherwise(0.0).alias("first_meeting_conflict_score"),
        missing["roles"].alias("role_mismatch_score"), missing["dates"].alias("temporal_mismatch_score"), missing["locations"].alias("location_mismatch_score"),
    )


def missing_ratio(claimed: Column, seen: Column) -> Column:
    """The share of the claimed values that are not seen; 0 if nothing is claimed."""
    return F.when(F.size(claimed) > 0, F.size(F.array_except(claimed, seen)) / F.size(claimed)).otherwise(0.0)


def rule_scores(examples: DataFrame, hard: DataFrame, soft: DataFrame) -> DataFrame:
    """Hard rules (character, description, patterns: all must occur) and soft terms (character, term).

    Rules are joined by character; Spark broadcasts them only where they are small.
    """
    text = F.lower(F.concat_ws(" ", "caption", "content"))
    e = examples.select("id", A.canonical(F.col("character")).alias("character"), text.alias("_x"))
    h = e.join(hard, "character").where(F.size("patterns") > 0).where(F.forall("patterns", lambda p: F.col("_x").contains(F.lower(p)))).groupBy("id").agg(F.count("*").alias("hard_constraint_hits"), F.array_sort(F.collect_list("description")).alias("hd"))
    s = e.join(soft, "character").where(F.col("_x").contains(F.lower("term"))).groupBy("id").agg(F.count("*").alias("soft_constraint_hits"), F.array_sort(F.collect_list("term")).alias("sd"))
    out = e.select("id").join(h, "id", "left").join(s, "id", "left").fillna(0, ["hard_constraint_hits", "soft_constraint_hits"])
    none = F.expr(A.EMPTY)
    return out.select("id", "hard_constraint_hits", "soft_constraint_hits", F.concat(F.coalesce("hd", none), F.coalesce("sd", none)).alias("matched_constraints"), F.least(F.lit(1.0), 0.5 * F.col("hard_constraint_hits") + 0.1 * F.col("soft_constraint_hits")).alias("constraint_risk_score"))


def evidence_pack(retrieved: DataFrame, limit: int = 4) -> DataFrame:
    """Per claim the best support and contradiction candidates with previews."""
    against = F.col("channel").contains("contradiction") | F.col("channel").contains("incompatible")
    rows = retrieved.withColumn("section", F.when(against, "contradiction").otherwise("support"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("example_id", "claim_id", "section").orderBy("rank"))).where(f"n <= {limit}")
    item = F.struct("n", "chunk_id", T.preview(F.col("text"), 420).alias("preview"), F.col("channel").alias("why_retrieved"), F.col("final_score").alias("score"))
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("section") == s, item)))
    return rows.groupBy("example_id", "claim_id").agg(pick("support").alias("support_candidates"), pick("contradiction").alias("contradiction_candidates"))
