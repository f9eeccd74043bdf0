"""Answers of language models: prompts, lenient JSON, checks, retries, a cache, and fallbacks.

A client is an injected, picklable function ``client(messages: list[dict]) -> str``; it runs on
the executors, once a row, in Arrow batches. ``ask`` writes every round of calls before anything
looks at it, so each row has one call and one answer (but for tasks that are run again).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from versight.functions import text as T
from versight.functions.store import written
from versight.operators import planning, verify as V

CLAIM = ["example_id", "claim_id"]
MESSAGES = "array<struct<role:string,content:string>>"
SHAPE = '{"claim_id": 1, "verdict": "SUPPORTED|CONTRADICTED|INSUFFICIENT", "evidence": [{"chunk_id": "...", "quote": "..."}], "confidence": "LOW|MEDIUM|HIGH", "reasoning_short": "..."}'
SYSTEM = "You check a claim against passages of a novel. Answer with JSON only, in this shape: " + SHAPE + ". Quotes are copied exactly from a passage."
RETRY = "Retry with JSON only, in the given shape. Any quote must be copied exactly from a passage."


def find_json(text: str | None, opener: str = "{") -> str | None:
    """The first JSON value that begins with ``opener`` anywhere in a text, as JSON; prose and fences around it don't matter."""
    decoder, at = json.JSONDecoder(), 0
    while text and (at := text.find(opener, at)) >= 0:
        try:
            return json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at += 1
    return None


def lenient_json(text: Column, opener: str = "{") -> Column:
    """``find_json`` as a column."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: find_json(t, opener))

    run.__annotations__ = {}
    return run(text)


def verifier_messages(plans: DataFrame, retrieved: DataFrame, *, local: bool = True, top: int | None = None) -> DataFrame:
    """(ids, messages) of each claim that has chunks: the first six, compacted to 900 characters, or the first eight in full."""
    top = top or (6 if local else 8)
    text = F.left(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(900)) if local else F.col("text")
    shown = F.concat(F.lit("["), "chunk_id", F.lit("] " if local else "]\n"), text)
    chunks = retrieved.where(F.col("rank") <= top).groupBy(*CLAIM).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", shown.alias("x")))), lambda s: s["x"]), "\n\n").alias("listing"))
    ask = F.concat(F.lit("claim_id="), F.col("claim_id").cast("string"), F.lit("\nclaim="), "claim_text", F.lit("\nchunks:\n"), "listing")
    return plans.join(chunks, CLAIM).select(*CLAIM, F.array(_message("system", F.lit(SYSTEM)), _message("user", ask)).alias("messages"))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def ask(rows: DataFrame, client, *, out_col: str = "response") -> DataFrame:
    """Adds the client's answer to ``messages``, null where it raises; written, so that later plans read it and don't ask again."""
    schema = StructType([*rows.schema.fields, StructField(out_col, StringType())])

    def run(frames):
        for frame in frames:

            def one(messages):
                try:
                    return client([{"role": m["role"], "content": m["content"]} for m in messages])
                except Exception:  # a client may fail in any way
                    return None

            yield frame.assign(**{out_col: [one(m) for m in frame["messages"]]})

    return written(rows.mapInPandas(run, schema), "asked")


def keyed(rows: DataFrame, *, provider: str, model: str, temperature: float = 0.0) -> DataFrame:
    """Adds the columns of a cache entry: key, provider, model, temperature."""
    rows = rows.withColumns({"provider": F.lit(provider), "model": F.lit(model), "temperature": F.lit(float(temperature))})
    return rows.withColumn("key", V.cache_key(F.col("provider"), F.col("model"), F.col("temperature"), F.col("messages")))


def cached_ask(rows: DataFrame, client, cache_path: str, *, provider: str, model: str, temperature: float = 0.0) -> DataFrame:
    """Adds ``response``: from the cache where it has the key, else from the client, whose answers are appended to it.

    The cache is an ``answer_store``, of which the keys' buckets are read, or else a folder of JSON lines (key,
    provider, model, temperature, messages, output), which is read as a whole; of repeated
    keys one answer is used. Equal requests are asked once. Failures aren't kept.
    """
    from versight.sources import answer_store, io

    spark = rows.sparkSession
    rows = keyed(rows, provider=provider, model=model, temperature=temperature)
    kept = answer_store.exists(spark, cache_path)
    known = answer_store.get(rows, cache_path).withColumnRenamed("output", "response") if kept else io.read_cache(spark, cache_path).select("key", F.col("output").alias("response")).dropDuplicates(["key"]) if io.exists(spark, cache_path) else spark.createDataFrame([], "key string, response string")
    known = written(known, "cache")
    fresh = rows.join(known.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "provider", "model", "temperature", "messages")
    answers = written(ask(fresh, client).where("response is not null"), "answers")
    if kept:
        answer_store.put(answers.withColumnRenamed("response", "output"), cache_path)
    else:
        io.append_cache(answers, cache_path)
    return rows.join(known.unionByName(answers.select("key", "response")), "key", "left").drop("key", "provider", "model", "temperature")


def verify_with(plans: DataFrame, retrieved: DataFrame, client, *, retries: int = 2, confirm: bool = True, local: bool = True) -> DataFrame:
    """Verdicts of a model: asked again where an answer fails the checks, contradictions confirmed on their quotes alone.

    Claims without chunks, without a valid answer, or whose contradiction is not confirmed are
    INSUFFICIENT; ``reason`` says why. The verdict's columns are those of ``verify.verify``.
    """
    messages = written(verifier_messages(plans, retrieved, local=local), "messages")
    left, good = messages, None
    for turn in range(retries):
        asked = left if turn == 0 else left.withColumn("messages", F.concat("messages", F.array(_message("user", F.lit(RETRY)))))
        parsed = written(V.parse_verdicts(ask(asked, client), retrieved), "verdicts")
        valid = parsed.where("valid").drop("valid")
        good = valid if good is None else good.unionByName(valid)
        left = left.join(valid.select(*CLAIM), CLAIM, "left_anti")
    good = good.withColumn("reason", F.lit(None).cast("string"))
    if confirm:
        quotes = F.array_join(F.transform("quotes", lambda q: F.concat(F.lit("["), q["chunk_id"], F.lit("] "), q["quote"])), "\n")
        again = good.where("verdict = 'CONTRADICTED'").join(plans.select(*CLAIM, "claim_text"), CLAIM)
        text = F.concat(F.lit("Look at nothing but the passages quoted below. Do they still rule the claim out?\nclaim="), "claim_text", F.lit("\nquotes:\n"), quotes)
        second = written(V.parse_verdicts(ask(again.select(*CLAIM, F.array(_message("system", F.lit(SYSTEM)), _message("user", text)).alias("messages")), client), retrieved), "confirmed")
        sure = second.where("valid and verdict = 'CONTRADICTED'").select(*CLAIM, F.lit(True).alias("sure"))
        good = good.join(sure, CLAIM, "left").withColumn("lost", (F.col("verdict") == "CONTRADICTED") & F.col("sure").isNull())
        none = F.expr("cast(array() as array<struct<chunk_id:string,quote:string>>)")
        good = good.select(*CLAIM, F.when(F.col("lost"), "INSUFFICIENT").otherwise(F.col("verdict")).alias("verdict"), F.when(F.col("lost"), "LOW").otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("lost"), 0).otherwise(F.col("num_evidence")).cast("long").alias("num_evidence"), F.when(F.col("lost"), none).otherwise(F.col("quotes")).alias("quotes"), F.when(F.col("lost"), "Contradiction was not confirmed by second pass.").alias("reason"))
    rows = plans.select(*CLAIM).join(good, CLAIM, "left").join(messages.select(*CLAIM, F.lit(True).alias("asked")), CLAIM, "left")
    why = F.when(F.col("verdict").isNotNull(), F.col("reason")).when(F.col("asked").isNull(), "No retrieved chunks were provided.").otherwise("Verifier invalid after retries.")
    return rows.select(*CLAIM, F.coalesce("verdict", F.lit("INSUFFICIENT")).alias("verdict"), F.coalesce("confidence", F.lit("LOW")).alias("confidence"), F.get("quotes", F.lit(0))["chunk_id"].alias("evidence_chunk_id"), F.get("quotes", F.lit(0))["quote"].alias("quote"), F.coalesce("num_evidence", F.lit(0)).cast("long").alias("num_evidence"), why.alias("justification"))


CLAIM_LIST = "array<struct<claim_id:int,claim_text:string,keywords:array<string>>>"


def plan_with(examples: DataFrame, client, *, max_claims: int = 6, tries: int = 2) -> DataFrame:
    """Claim plans from a model's list of claims; examples without a usable list get the sentence planner's."""
    prompt = F.concat(F.lit(f"List at most {max_claims} atomic factual claims of this backstory as a JSON list of objects with claim_id and claim_text.\nBook: "), F.coalesce("book_name", F.lit("")), F.lit("\nCharacter: "), F.coalesce("character", F.lit("")), F.lit("\nBackstory: "), F.coalesce("content", F.lit("")))
    left, found = examples.select("id", "book_name", "character", "content"), None
    for _ in range(tries):
        claims = F.from_json(lenient_json(F.col("response"), "["), CLAIM_LIST)
        texts = F.filter(F.transform(F.slice(claims, 1, max_claims), lambda c: F.trim(c["claim_text"])), lambda t: F.coalesce(t, F.lit("")) != "")
        asked = ask(left.select("id", "book_name", "character", "content", F.array(_message("user", prompt)).alias("messages")), client)
        got = written(asked.select("id", "book_name", "character", texts.alias("texts"), (F.size(texts) == F.least(F.size(claims), F.lit(max_claims))).alias("whole")).where("whole and size(texts) > 0").drop("whole"), "plans")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("id"), "id", "left_anti")
    return planning.plan_texts(found.select("id", "book_name", "character", F.posexplode("texts").alias("p", "claim_text"))).unionByName(planning.plan_claims(left, max_claims=max_claims))


def generate_claims(examples: DataFrame, client, *, least: int = 3) -> DataFrame:
    """Adds ``claims``: the model's list, or an empty one unless it has ``least`` claims numbered from 1 with texts over ten characters and keywords."""
    prompt = F.concat(F.lit(f"Extract at least {least} atomic claims as a JSON list of objects with claim_id (from 1), claim_text and keywords.\nCharacter: "), F.coalesce("character", F.lit("")), F.lit("\nBook: "), F.coalesce("book_name", F.lit("")), F.lit("\nBackstory: "), F.coalesce("content", F.lit("")))
    rows = ask(examples.withColumn("messages", F.array(_message("user", prompt))), client)
    claims = F.from_json(lenient_json(F.col("response"), "["), CLAIM_LIST)
    fits = F.forall(F.transform(claims, lambda c, i: (c["claim_id"] == i + 1) & (F.length(c["claim_text"]) > 10) & c["keywords"].isNotNull()), lambda ok: F.coalesce(ok, F.lit(False)))
    return rows.withColumn("claims", F.when((F.size(claims) >= least) & fits, claims).otherwise(F.expr(f"cast(array() as {CLAIM_LIST})"))).drop("messages", "response")


def fallback_contradictions(claim: Column) -> Column:
    """Three fixed templates."""
    return F.array(F.concat(F.lit("The story shows that the opposite of '"), claim, F.lit("' is true.")), F.concat(F.lit("Events in the novel contradict the idea that '"), claim, F.lit("'.")), F.concat(F.lit("The narrative provides evidence against '"), claim, F.lit("'.")))


def generate_contradictions(claims: DataFrame, client, *, number: int = 3) -> DataFrame:
    """Adds ``contradictions``: exactly ``number``; the templates where the answer is no list."""
    prompt = F.concat(F.lit(f"Write exactly {number} sentences of a novel that each negate this claim, as a JSON list of strings.\nClaim: "), "claim_text")
    rows = ask(claims.withColumn("messages", F.array(_message("user", prompt))), client)
    found = F.from_json(lenient_json(F.col("response"), "["), "array<string>")
    pad = F.array_repeat(F.concat(F.lit("Narrative evidence contradicts the claim that "), "claim_text"), number)
    return rows.withColumn("contradictions", F.slice(F.concat(F.coalesce(F.filter(found, lambda x: x.isNotNull()), fallback_contradictions(F.col("claim_text"))), pad), 1, number)).drop("messages", "response")


def label_passages(rows: DataFrame, client) -> DataFrame:
    """Adds ``result`` (verdict, contradictions) for rows of backstory, claim_chunk and contra_evidence; an error gives an ERROR verdict."""
    kind = "struct<verdict:string,contradictions:array<struct<passage:string,reason:string>>>"
    evidence = F.filter(F.concat(F.array("claim_chunk"), F.coalesce(F.transform("contra_evidence", lambda c: c["evidence"]), F.expr("cast(array() as array<string>)"))), lambda e: F.coalesce(e, F.lit("")) != "")
    prompt = F.concat(F.lit("BACKSTORY:\n"), "backstory", F.lit("\n\nEVIDENCE:\n"), F.array_join(evidence, "\n"), F.lit("\n"))
    out = ask(rows.withColumn("messages", F.array(_message("system", F.lit("Answer with JSON only: " + '{"verdict": "...", "contradictions": [{"passage": "...", "reason": "..."}]}')), _message("user", prompt))), client)
    parsed = F.from_json(lenient_json(F.col("response")), kind)
    failed = F.from_json(F.lit('{"verdict": "ERROR", "contradictions": [{"passage": "", "reason": "no valid answer"}]}'), kind)
    return out.withColumn("result", F.when(parsed["verdict"].isNotNull(), parsed).otherwise(failed)).drop("messages", "response")


def justified(raw: DataFrame, passages: DataFrame, *, text_col: str = "response", most_words: int = 40) -> DataFrame:
    """(ids, valid, verdict, confidence, num_evidence) of answers that cite numbered passages.

    passages: ids and ``texts``, an array. All five fields are needed, chunk ids have to be
    places of the array, quotes exact substrings, the justification at most ``most_words`` words.
    """
    kind = "struct<claim_id:string,verdict:string,evidence:array<struct<chunk_id:int,quote:string>>,confidence:string,justification:string>"
    x = raw.select(*CLAIM, F.from_json(lenient_json(F.col(text_col)), kind).alias("j")).join(passages.select(*CLAIM, "texts"), CLAIM, "left")
    j = F.col("j")
    exact = F.forall(j["evidence"], lambda e: F.coalesce((e["chunk_id"] >= 0) & F.get(F.col("texts"), e["chunk_id"]).contains(e["quote"]), F.lit(False)))
    cited = (j["verdict"] == "INSUFFICIENT") | (F.size(j["evidence"]) > 0)
    ok = j["claim_id"].isNotNull() & j["verdict"].isin("SUPPORTED", "CONTRADICTED", "INSUFFICIENT") & j["confidence"].isin("LOW", "MEDIUM", "HIGH") & j["evidence"].isNotNull() & exact & cited & (F.size(T.words(j["justification"])) <= most_words)
    ok = F.coalesce(ok, F.lit(False))
    return x.select(*CLAIM, ok.alias("valid"), F.when(ok, j["verdict"]).otherwise("INSUFFICIENT").alias("verdict"), F.when(ok, j["confidence"]).otherwise("LOW").alias("confidence"), F.when(ok, F.size(j["evidence"])).otherwise(0).cast("long").alias("num_evidence"))


def verify_numbered(claims: DataFrame, passages: DataFrame, client, *, top: int = 5, tries: int = 2) -> DataFrame:
    """Verdicts on claims (ids, claim_text) over their first ``top`` numbered passages (ids, texts); INSUFFICIENT where no try is valid."""
    own = passages.select(*CLAIM, F.slice("texts", 1, top).alias("texts"))
    listing = F.array_join(F.transform("texts", lambda t, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), t)), "\n")
    shape = '{"claim_id": "...", "verdict": "SUPPORTED|CONTRADICTED|INSUFFICIENT", "evidence": [{"chunk_id": 0, "quote": "..."}], "confidence": "LOW|MEDIUM|HIGH", "justification": "at most 40 words"}'
    ask_for = F.array(_message("system", F.lit("Answer with JSON only: " + shape)), _message("user", F.concat(F.lit("Claim "), F.col("claim_id").cast("string"), F.lit(": "), "claim_text", F.lit("\nPassages:\n"), listing)))
    left, good = written(claims.join(own, CLAIM).select(*CLAIM, ask_for.alias("messages")), "messages"), None
    for _ in range(tries):
        valid = written(justified(ask(left, client), own), "verdicts").where("valid").drop("valid")
        good = valid if good is None else good.unionByName(valid)
        left = left.join(valid.select(*CLAIM), CLAIM, "left_anti")
    rows = claims.select(*CLAIM).join(good, CLAIM, "left")
    return rows.select(*CLAIM, F.coalesce("verdict", F.lit("INSUFFICIENT")).alias("verdict"), F.coalesce("confidence", F.lit("LOW")).alias("confidence"), F.coalesce("num_evidence", F.lit(0)).cast("long").alias("num_evidence"))


def verify_loosely(plans: DataFrame, retrieved: DataFrame, client) -> DataFrame:
    """Verdicts taken from answers as they are: no check of quotes, no retry; what is missing has defaults.

    All chunks of a claim are shown, and count as evidence of a verdict that needs some. An answer
    without JSON is INSUFFICIENT.
    """
    listing = retrieved.groupBy(*CLAIM).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.concat(F.lit("["), "chunk_id", F.lit("] "), "text").alias("x")))).alias("e"))
    x = plans.join(listing, CLAIM, "left").withColumn("e", F.coalesce("e", F.expr("cast(array() as array<struct<rank:int,chunk_id:string,x:string>>)")))
    text = F.concat(F.lit("claim: "), "claim_text", F.lit("\nchunks:\n"), F.array_join(F.transform("e", lambda c: c["x"]), "\n"))
    rows = ask(x.select(*CLAIM, F.transform("e", lambda c: c["chunk_id"]).alias("chunks"), F.array(_message("system", F.lit(SYSTEM)), _message("user", text)).alias("messages")), client)
    rows = rows.withColumn("j", F.from_json(lenient_json(F.col("response")), "struct<verdict:string,confidence:string,justification:string,reasoning_short:string>"))
    verdict = F.coalesce("j.verdict", F.lit("INSUFFICIENT"))
    due = verdict.isin("SUPPORTED", "CONTRADICTED")
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    why = F.coalesce(filled("j.justification"), filled("j.reasoning_short"), F.lit("The answer gives no reason."))
    return rows.select(*CLAIM, verdict.alias("verdict"), F.coalesce("j.confidence", F.lit("LOW")).alias("confidence"), F.when(due, F.get("chunks", F.lit(0))).alias("evidence_chunk_id"), F.lit(None).cast("string").alias("quote"), F.when(due, F.size("chunks")).otherwise(0).cast("long").alias("num_evidence"), why.alias("justification"))


def verify_claims(plans: DataFrame, retrieved: DataFrame, *, verifier=None, client=None, **options) -> DataFrame:
    """Verdicts by ``verifier(retrieved, plans)`` if given, else by a model's client, else by the deterministic rules."""
    if verifier is not None:
        return verifier(retrieved, plans)
    return V.verify(retrieved, plans) if client is None else verify_with(plans, retrieved, client, **options)


def sample(rows: DataFrame, number: int = 1) -> str:
    """The first rows (by id) of generated contradictions as text to look at: id, char, contradictions (a map from claim to sentences)."""
    out = []
    for r in rows.select("id", "char", "contradictions").orderBy("id").limit(number).collect():
        out.append(f"id={r.id} char={r.char}")
        for claim, sentences in sorted((r.contradictions or {}).items()):
            out += [f"  claim {claim}", *(f"    {i}. {x}" for i, x in enumerate(sentences, 1))]
    return "\n".join(out)


def insufficient(plans: DataFrame, reason: str) -> DataFrame:
    """The verdict of claims that failed, with why (500 characters at most)."""
    return V.null_verdicts(plans).withColumn("justification", F.lit(reason[:500]))


__all__ = ["ask", "cached_ask", "fallback_contradictions", "find_json", "generate_claims", "generate_contradictions", "insufficient", "justified", "keyed", "label_passages", "lenient_json", "plan_with", "sample", "verifier_messages", "verify_claims", "verify_loosely", "verify_numbered", "verify_with"]
