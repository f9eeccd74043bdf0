"""Personal data by fixed forms, and by bootstrapped contextual extraction. Built-in functions only.

Fixed forms (the seeds) are found by patterns, leftmost and not overlapping for each kind.
Positions come from the gaps between matches: ``split`` and ``regexp_extract_all`` walk over
the same matches. The patterns are written so that they match as the plain ones do without
trying again inside a run of digits or letters that has failed, and without recursion, so
that long runs cost linear time.

Bootstrapping:

1. Seeds are the fixed forms. Instances are these, and every word or run of up to ``RUN``
   words that stands at a candidate pattern and overlaps no fixed form.
2. Patterns: the word before and the word after an instance, lower-cased, digits as 0, for
   each kind: (before, after), (before, any) and (any, after). Runs of several words count at
   (before, after); at the other two, whose far end is open, only whole runs of words that
   hold digits do.
3. Scores: an instance that is a seed of the kind counts 1, a seed of another kind 0,
   others start at 0. A pattern's confidence is (sum of its distinct instances' scores) /
   (number of them + ``prior``); an instance's score is 1 - product of (1 - confidence) of
   its confident patterns. A pattern is confident at ``confidence`` with ``support`` distinct
   instances that score as much. Scores only grow, so rounds end when no pattern is new.
4. A candidate is a pattern that has ``support`` such instances. Its distinct instances are
   counted over the texts, aggregated before the shuffle, unless a bound shows that they are
   too many (see ``discover``). What confident patterns discover is looked up in the texts for
   its own contexts, which may make more candidates; at last mentions at confident patterns
   become spans of the pattern's kind; of overlapping ones the longest, then the first.

A frequent context (a third of all rows) is one pattern with many instances; sums are
aggregated before the shuffle, and joins on patterns are split by adaptive execution.
Words that hold the character NUL are taken for parts of fixed forms.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from versight.llm.shared import discard, let, written

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text may hold the kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": "+"}

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a run, at most.
RUN = 4
BLOCK = 256
BROADCAST_ROWS = 10_000
#: Keys that texts are tested for before they are taken apart into rows; with more keys all texts are.
HELD_KEYS = 20_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string passes the check sum."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


SPAN = "array<struct<start:int,end:int,m:string,before:string,after:string>>"


def _plain(x: Column) -> Column:
    """Lower-cased, digits as 0."""
    return F.translate(F.lower(x), "123456789", "000000000")


def _near(gap: Column, last: bool) -> Column:
    """The last or first word of a gap; linear in its length."""
    word = F.regexp_extract(F.reverse(gap) if last else gap, r"\A[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++)", 1)
    return _plain(F.reverse(word) if last else word)


def _placed(parts: Column) -> Column:
    """Adds start and end to array<struct<g, m, before, after>>: running sums, in blocks so that
    the work grows with the number of matches times the block."""

    def run(block: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["g"])
            end = start + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))).alias("out"))

        return F.aggregate(block, zero, add, lambda acc: acc["out"])

    def blocks(parts: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
        total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["g"]) + F.length(x["m"]))

        def offsets(cut: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
            starts = F.aggregate(F.transform(cut, total), zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return let(starts, lambda at: F.flatten(F.transform(cut, lambda block, i: run(block, F.get(at, i)))))

        return let(cut, offsets)

    return F.when(F.size(parts) == 0, F.expr(f"cast(array() as {SPAN})")).when(F.size(parts) <= BLOCK, run(parts, F.lit(0))).otherwise(blocks(parts))


def spans_of(text: Column, pattern: str) -> Column:
    """All matches with their place in code points and the words around them."""

    def parts(both: Column) -> Column:
        gaps, found = both["gaps"], both["found"]

        def around(m: Column, i: Column) -> Column:
            before, after = _near(F.get(gaps, i), True), _near(F.get(gaps, i + 1), False)
            return F.struct(F.get(gaps, i).alias("g"), m.alias("m"), F.when(before == "", F.coalesce(_plain(F.get(found, i - 1)), F.lit(""))).otherwise(before).alias("before"), F.when(after == "", F.coalesce(_plain(F.get(found, i + 1)), F.lit(""))).otherwise(after).alias("after"))

        return let(F.transform(found, around), _placed)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), parts)


def _hinted(kind: str, text: Column) -> Column:
    hint = HINTS[kind]
    return text.contains(hint) if kind in ("email", "phone") else text.rlike(hint)


def base_spans(text: Column) -> Column:
    """array<struct<kind (its number), start, end, m, before, after>> of the fixed forms, by kind, then start."""

    def of(number: int, kind: str) -> Column:
        good = F.filter(spans_of(text, PATTERNS[kind]), lambda x: _valid(kind, x["m"]))
        named = F.transform(good, lambda x: F.struct(F.lit(number).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))
        return F.when(_hinted(kind, text), named).otherwise(F.expr("cast(array() as array<struct<kind:int,start:int,end:int,m:string,before:string,after:string>>)"))

    return F.concat(*(of(i, k) for i, k in enumerate(KINDS)))


def _masked(text: Column, base: Column) -> Column:
    """The text with NUL for each character of the fixed forms."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(acc["at"], x["start"])
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, start - acc["at"]), F.repeat(F.lit("\0"), x["end"] - start))
        return F.when(x["end"] > acc["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(acc)

    places = F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))))
    return F.when(F.size(base) == 0, text).otherwise(F.aggregate(places, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"]))))


def _pattern(before: Column, after: Column) -> list[Column]:
    """Keys of the three patterns, from hashes of the words (null: no word)."""
    return [F.when(before.isNotNull() | after.isNotNull(), F.xxhash64(F.lit(0), before, after)), F.when(before.isNotNull(), F.xxhash64(F.lit(1), before)), F.when(after.isNotNull(), F.xxhash64(F.lit(2), after))]


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k (hash of the text), base of each row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.select("_id", F.xxhash64("_text").alias("_k"), base_spans(F.coalesce("_text", F.lit(""))).alias("base"))


def _seeds(rows: DataFrame) -> DataFrame:
    """Distinct (p, inst, kind, hb, ha) of the fixed forms; hb and ha are the words around, for patterns of both sides."""
    mention = rows.where(F.size("base") > 0).select(F.explode("base").alias("x")).select("x.*")
    word = lambda c: F.when(F.col(c) != "", F.xxhash64(c))
    inst = F.xxhash64(F.lower("m")).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.col("m").rlike("[0-9]"), 1).otherwise(0).cast("long"))
    return _edges(mention.select(F.array(*_pattern(word("before"), word("after"))).alias("ps"), word("before").alias("b"), word("after").alias("a"), inst.alias("inst"), "kind")).distinct()


def _edges(found: DataFrame) -> DataFrame:
    """A row for each pattern of ``ps``, as p, hb and ha, with the other columns."""
    others = [c for c in found.columns if c not in ("ps", "b", "a")]
    both = lambda c: F.when(F.col("t") == 0, F.col(c)).alias(f"h{c}")
    return found.select(*others, "b", "a", F.posexplode("ps").alias("t", "p")).where("p is not null").select("p", *others, both("b"), both("a"))


def _split(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text, w (lower-cased words, fixed forms as NUL) and c (the same with digits as 0) of rows with a word."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_text").rlike(WORD))
    low = F.lower(_masked(F.col("_text"), base_spans(F.col("_text"))))
    words = lambda x: F.array_remove(F.split(x, r"[\x20\x09-\x0D]+", -1), "")
    return rows.select("_id", "_text", low.alias("low")).select("_id", "_text", words(F.col("low")).alias("w"), words(F.translate("low", "123456789", "000000000")).alias("c"))


def _own(w: Column, c: Column) -> Column:
    """Hash of a word; its last bit tells whether the word holds a digit."""
    return F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(c.contains("0"), 1).otherwise(0).cast("long"))


def _holding(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, patterns: bool) -> DataFrame:
    """The ids and texts that hold one of the keys: of patterns, or of words. All of ``docs`` if the keys are many.

    Keys of a text are arrays of hashes, so only texts that matter are taken apart into rows.
    """
    both = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col))
    if wanted.count() > HELD_KEYS:
        return both
    keys = F.from_json(F.lit(json.dumps([r[0] for r in wanted.collect()])), "array<long>")

    def of_patterns(h: Column) -> Column:
        ends = F.concat(F.array(F.lit(None).cast("long")), h, F.array(F.lit(None).cast("long")))
        pair = lambda b, a: F.xxhash64(F.lit(0), b, a)
        around = lambda e: [F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - n - 1, F.lit(0))), F.slice(e, F.lit(n + 2), F.size(e)), pair) for n in range(1, RUN + 1)]
        return let(ends, lambda e: F.concat(F.transform(h, lambda x: F.xxhash64(F.lit(1), x)), F.transform(h, lambda x: F.xxhash64(F.lit(2), x)), *around(e)))

    own = let(F.transform("c", lambda x: F.xxhash64(x)), of_patterns) if patterns else F.zip_with("w", "c", _own)
    return _split(docs, id_col, text_col).where(F.arrays_overlap(own, keys)).select(F.col("_id").alias(id_col), F.col("_text").alias(text_col))


def _slots(docs: DataFrame, id_col: str, text_col: str, longer: bool, befores: DataFrame | None = None, firsts: DataFrame | None = None) -> DataFrame:
    """(_id, _k, i, l, inst, w, b, a, ps): words, or longer runs, outside fixed forms by the number of their first word, and their patterns.

    w, b and a are the hashes of the first word and of the words before and after. Longer runs are taken
    where ``befores`` (h, afters) has the word before and one of the words after, and where the
    words hold digits; or else where ``firsts`` (h) has the first word. Neighbours are
    zipped arrays, so what follows runs row by row in generated code.
    """
    rows = _split(docs, id_col, text_col).withColumn("_k", F.xxhash64("_text"))
    size = F.size("w")
    shift = lambda c, j: F.slice(c, j + 1, size).alias(f"{c}{j}") if j else F.col(c).alias(f"{c}0")
    last = RUN if longer else 1
    parts = [F.sequence(F.lit(0), size).alias("i"), F.concat(F.array(F.lit(None).cast("string")), F.col("c")).alias("b"), *(shift("w", j) for j in range(last)), *(shift("c", j) for j in range(last + 1))]
    x = rows.select("_id", "_k", F.inline(F.arrays_zip(*parts))).toDF("_id", "_k", "i", "b", *(f"w{j}" for j in range(last)), *(f"c{j}" for j in range(last + 1)))
    digit = lambda c: F.coalesce(F.col(c).contains("0") & ~F.col(c).contains("\0"), F.lit(False))
    x = x.where("w0 is not null").where(~F.col("w0").contains("\0"))
    word = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c)))
    inst = lambda j: F.when(~F.col(f"w{j}").contains("\0"), _own(F.col(f"w{j}"), F.col(f"c{j}")))
    if not longer:
        x = x.select("_id", "_k", "i", inst(0).alias("inst"), word("b").alias("b"), word("c1").alias("a"))
        return x.select("_id", "_k", "i", F.lit(1).alias("l"), "inst", F.col("inst").alias("w"), "b", "a", F.array(*_pattern(F.col("b"), F.col("a"))).alias("ps"))
    few = lambda df: F.broadcast(df) if df.count() <= 50 * BROADCAST_ROWS else df
    if befores is not None:
        after = F.array(*(F.xxhash64(F.col(f"c{j}")) for j in range(2, last + 1)))
        x = x.withColumn("h", word("b")).join(few(befores), "h", "left").where((F.coalesce(F.arrays_overlap("afters", after), F.lit(False)) | (digit("c0") & digit("c1")))).drop("h")
    else:
        x = x.withColumn("h", inst(0)).join(few(firsts), "h", "left_semi").drop("h")
    runs = []
    x = x.select("_id", "_k", "i", word("b").alias("b"), (~digit("b")).alias("d"), *(inst(j).alias(f"g{j}") for j in range(last)), *(word(f"c{j}").alias(f"a{j}") for j in range(2, last + 1)), *(digit(f"c{j}").alias(f"d{j}") for j in range(last + 1)))
    for n in range(2, RUN + 1):
        both, *open_ = _pattern(F.col("b"), F.col(f"a{n}"))
        whole, digits = F.lit(True), F.col("d") & ~F.col(f"d{n}")
        for m in range(n):
            whole, digits = whole & F.col(f"g{m}").isNotNull(), digits & F.col(f"d{m}")
        ps = F.array(F.when(F.col("b").isNotNull() & F.col(f"a{n}").isNotNull() | digits, both), *(F.when(digits, o) for o in open_))
        runs.append(F.when(whole, F.struct(F.lit(n).alias("l"), F.xxhash64(*(F.col(f"g{m}") for m in range(n))).alias("inst"), F.col(f"a{n}").alias("a"), ps.alias("ps"))))
    return x.select("_id", "_k", "i", F.col("g0").alias("w"), "b", F.explode(F.array(*runs)).alias("r")).where("r is not null").select("_id", "_k", "i", "r.l", "r.inst", "w", "b", "r.a", "r.ps")


def discover(docs: DataFrame, rows: DataFrame, *, id_col: str, text_col: str, confidence: float = 0.8, support: int = 5, prior: float = 1.0, probe: int = 32) -> DataFrame:
    """(_id, _k, kind, start, end) of mentions that confident patterns find, each place once.

    A pattern's sum of scores comes from the contexts of the instances that score, which are
    all known; only the number of its distinct instances needs the texts. At a sum s it may
    be s / confidence - prior at most. A ``probe``-th of the texts bounds the number from below,
    and who is over the bound there can't be confident at this sum; the others are counted
    over all texts. So the result is that of counting every pattern over all texts.
    """
    some = lambda df: F.broadcast(df) if df.count() <= 50 * BROADCAST_ROWS else df
    pair = ["p", "inst"]

    def met(patterns: DataFrame, source: DataFrame) -> DataFrame:
        """Mentions at the given patterns (p): (p, inst, w, _id, _k, i, l)."""
        befores = written(heads.join(patterns.select("p"), "p", "left_semi").groupBy(F.col("hb").alias("h")).agg(F.collect_set("ha").alias("afters")), "befores")
        one = some(patterns.select("p").distinct())
        slots = (_slots(source, id_col, text_col, False), _slots(source, id_col, text_col, True, befores))
        out = [_edges(x).join(one, "p").drop("hb", "ha") for x in slots]
        return out[0].unionByName(out[1])

    seeds = written(_seeds(rows), "seeds")
    heads = seeds.where("hb is not null and ha is not null").select("p", "hb", "ha").distinct()
    known = written(seeds.select("inst", "kind").distinct().withColumn("score", F.lit(1.0)), "known")
    contexts, scores = written(seeds.select(*pair).distinct(), "contexts"), known
    part = docs.where(F.pmod(F.xxhash64(text_col), F.lit(probe)) == 0)
    spark = docs.sparkSession
    bounds = spark.createDataFrame([], "p long, n long, exact boolean")
    edges = spark.createDataFrame([], "p long, inst long, l int, w long")
    asked, n_good, good = None, 0, None

    def number(found: DataFrame, of: DataFrame) -> DataFrame:
        """(p, n): distinct instances, those of the contexts included."""
        return contexts.join(of.select("p"), "p", "left_semi").unionByName(found.select(*pair)).distinct().groupBy("p").agg(F.count("*").alias("n"))

    while True:
        sums = contexts.join(scores, "inst").groupBy("p", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= confidence).alias("c")).where(f"c >= {support}")
        sums = written(sums, "sums")
        most = sums.groupBy("p").agg((F.max("sum") / confidence - prior).alias("most"))
        todo = written(most.join(bounds, "p", "left").where("n is null or (not exact and n <= most)").select("p", "most"), "candidates")
        if not todo.isEmpty():
            low = written(number(met(todo, part).select(*pair), todo), "bounds")
            left = written(todo.join(low, "p", "left").where("n is null or n <= most").select("p"), "candidates")
            whole = low.join(left, "p", "left_anti").withColumn("exact", F.lit(False))
            if not left.isEmpty():
                held = written(_holding(docs, id_col, text_col, left, True), "held")
                found = written(met(left, held).select(*pair, "l", "w").distinct(), "graph")
                discard(held)
                edges = edges.unionByName(found)
                whole = whole.unionByName(number(found, left).withColumn("exact", F.lit(True)))
            bounds = written(bounds.join(todo, "p", "left_anti").unionByName(whole), "bounds")
        good = written(sums.join(bounds.where("exact"), "p").withColumn("conf", F.col("sum") / (F.col("n") + prior)).where(f"conf >= {confidence}").select("p", "kind", "conf"), "patterns")
        if (n := good.count()) == n_good:
            break
        n_good = n
        unseen = edges.join(good, "p").join(known.select("inst").distinct(), "inst", "left_anti")
        scored = written(unseen.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"), F.max("l").alias("l"), F.max("w").alias("w")), "scores")
        scores = known.unionByName(scored.select("inst", "kind", "score"))
        # all that scores does so by a confident pattern, so its score is at least ``confidence``
        new = scored.select("inst", "l", "w").dropDuplicates(["inst"])
        new = written(new if asked is None else new.join(asked, "inst", "left_anti"), "found")
        if new.isEmpty():
            continue
        asked = new.select("inst") if asked is None else asked.unionByName(new.select("inst"))
        few = some(new.select("inst"))
        held = written(_holding(docs, id_col, text_col, new.select("w").distinct(), False), "held")
        more = _edges(_slots(held, id_col, text_col, False).join(few, "inst", "left_semi"))
        if not new.where("l > 1").isEmpty():
            firsts = written(new.where("l > 1").select(F.col("w").alias("h")).distinct(), "firsts")
            more = more.unionByName(_edges(_slots(held, id_col, text_col, True, None, firsts).join(few, "inst", "left_semi")))
        more = written(more.select(*pair, "hb", "ha").distinct(), "contexts")
        discard(held)
        heads = heads.unionByName(more.where("hb is not null and ha is not null").select("p", "hb", "ha")).distinct()
        contexts = written(contexts.unionByName(more.select(*pair)).distinct(), "contexts")
    if not n_good or edges.join(good.select("p").distinct(), "p", "left_semi").isEmpty():  # fixed forms alone stand at confident patterns
        return spark.createDataFrame([], f"_id {dict(rows.dtypes)['_id']}, _k long, kind int, start int, end int")
    best = F.max_by("kind", F.struct("conf", -F.col("kind"))).alias("kind")
    held = written(_holding(docs, id_col, text_col, good.select("p").distinct(), True), "held")
    hits = written(met(good, held).join(some(good), "p").groupBy("_id", "_k", "i", "l").agg(best), "hits")
    places = hits.groupBy("_id", "_k").agg(F.array_sort(F.collect_list(F.struct("i", -F.col("l"), "l", "kind"))).alias("at"))
    texts = held.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text")).dropDuplicates(["_i", "_h"])
    placed = places.join(texts, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_k") == F.col("_h")))
    spans = let(spans_of(_masked(F.col("_text"), base_spans(F.col("_text"))), WORD), lambda w: F.transform("at", lambda x: F.struct(F.get(w, x["i"])["start"].alias("start"), F.get(w, x["i"] + x["l"] - 1)["end"].alias("end"), x["kind"].alias("kind"))))
    # longest first among overlapping ones: a span goes if a longer one, or an earlier one as long, is kept over it
    order = F.array_sort(F.transform(spans, lambda x: F.struct((x["start"] - x["end"]).alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    kept = F.aggregate(order, F.expr("cast(array() as array<struct<n:int,start:int,end:int,kind:int>>)"), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    out = written(placed.select("_id", "_k", F.explode(kept).alias("x")).select("_id", "_k", "x.kind", "x.start", "x.end"), "discovered")
    discard(held, hits)
    return out


def _all_spans(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows with ``spans``: fixed forms and discovered ones, by kind, then start."""
    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    new = discover(docs, rows, id_col=id_col, text_col=text_col)
    if new.isEmpty():
        return rows.withColumn("spans", F.transform("base", place))
    more = new.groupBy(F.col("_id").alias("_i"), F.col("_k").alias("_h")).agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    met = rows.join(more, F.col("_id").eqNullSafe(F.col("_i")) & F.col("_k").eqNullSafe(F.col("_h")), "left")
    return met.withColumn("spans", F.array_sort(F.concat(F.transform("base", place), F.coalesce("new", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)"))))).drop("_i", "_h", "new")


def _text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of each row.

    Counts and the digest are of the fixed forms; spans holds these and the discovered
    ones as kind:start:end (code points, end exclusive). Null and empty texts have no
    spans (the digest is that of the empty string); null ids are carried; repeated rows
    repeat; an empty table gives an empty result. Only the two named columns are read.
    """
    rows = _all_spans(docs, written(_scan(docs, id_col, text_col), "spans"), id_col, text_col)
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {i})")).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select(F.col("_id").alias(id_col), *counts, F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in brackets; all columns and rows stay.

    Fixed forms are replaced where the row stands. Discovered spans are joined to it: by a
    broadcast if they are few (``BROADCAST_ROWS`` at most, counted), else by a shuffle.
    """
    rows = written(_scan(docs, id_col, text_col).where(F.size("base") > 0), "spans")
    new = discover(docs, rows, id_col=id_col, text_col=text_col)
    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
    text, out = F.col(f"`{text_col}`"), docs
    # names that no column of the input has
    free = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    vi, vk, vnew = (f"{free}{x}" for x in ("vi", "vk", "vnew"))
    extra = F.expr("cast(array() as array<struct<start:int,end:int,kind:int>>)")
    if not new.isEmpty():
        more = new.groupBy(F.col("_id").alias(vi), F.col("_k").alias(vk)).agg(F.collect_list(F.struct("start", "end", "kind")).alias(vnew))
        more = F.broadcast(more) if new.count() <= BROADCAST_ROWS else more
        out = docs.join(more, F.col(id_col).eqNullSafe(F.col(vi)) & F.xxhash64(text).eqNullSafe(F.col(vk)), "left")
        extra = F.coalesce(vnew, extra)

    def replaced(spans: Column) -> Column:
        # where spans overlap, the first stands and the rest of the others goes with it
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
        step = lambda acc, x: F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))).alias("out"))
        return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))

    spans = F.array_sort(F.concat(F.transform(base_spans(F.coalesce(text, F.lit(""))), place), extra))
    new_text = let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(replaced(s)))
    return out.select(*(new_text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
