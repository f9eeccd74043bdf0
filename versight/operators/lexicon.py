"""Phrases of a lexicon that is a table, found in texts by hashed n-grams: one pass over a text for any number of phrases.

A text is folded and cut into pieces: runs of word characters, and single other characters.
A whole phrase is a run of pieces; where it begins or ends with a word, the pieces' edges are the
word's. Each piece's hash meets a bitmap of the phrases' first pieces, of fixed size. Where it passes, the
runs of the lexicon's lengths meet a bitmap of whole phrases, and what passes that meets the lexicon in a join.
The plan has the same size for every lexicon.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the bitmap, a power of two.
BITMAP = 1 << 17


@lru_cache(maxsize=1)
def _unlike() -> tuple[str, str]:
    """Letters whose upper case has another lower case than they have, and that one; letters that lower() may expand or look around for."""
    pairs = {"İ": "i", "Σ": "σ", "ς": "σ"}
    for i in range(0x80, 0x10000):
        c = chr(i)
        up = c.upper() if len(c.upper()) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else up
        if c not in pairs and not 0xD800 <= i < 0xE000 and low != c.lower():
            pairs[c] = low
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Lower case of each character's upper case, as patterns without regard to case compare."""
    unlike, like = _unlike()
    return F.lower(F.when(text.rlike(f"[{unlike}]"), F.translate(text, unlike, like)).otherwise(text))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"(?U)\w+|\W"), F.lit(0))


def prepared(lexicon: DataFrame) -> DataFrame:
    """(phrase and other columns, h, f, k, first, last, again): hashes of a phrase and its first piece, their number, whether its ends aren't words, and whether it can overlap itself."""
    p = lexicon.where("phrase != ''").withColumn("_p", pieces(F.col("phrase")))
    p = p.withColumn("k", F.size("_p"))
    border = F.exists(F.when(F.col("k") > 1, F.sequence(F.lit(1), F.col("k") - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda b: F.slice("_p", 1, b) == F.slice("_p", F.col("k") - b + 1, b))
    word = lambda c: c.rlike(r"(?U)\A\w")
    return p.select(*lexicon.columns, F.xxhash64("_p").alias("h"), F.xxhash64(F.element_at("_p", 1)).alias("f"), "k", (~word(F.element_at("_p", 1))).alias("first"), (~word(F.element_at("_p", -1))).alias("last"), border.alias("again"))


def _bitmap(hashes: DataFrame, h: str) -> Column:
    """The literal array of longs that has the low bits of the hashes."""
    words = dict.fromkeys(range(BITMAP // 64), 0)
    at = F.col(h).bitwiseAND(BITMAP - 1)
    for r in hashes.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))).alias("m")).collect():
        words[r.w] = r.m
    return F.split(F.lit(",".join(map(str, words.values()))), ",").cast("array<long>")


def _in(bits: Column, h: Column) -> Column:
    return F.call_function("getbit", F.get(bits, F.shiftright(h.bitwiseAND(BITMAP - 1), 6).cast("int")), h.bitwiseAND(63).cast("int")) == 1


def phrase_counts(texts: DataFrame, lexicon: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """(key, lexicon's columns, n) of the phrases that a text holds as whole phrases, without regard to case, left to right without overlaps.

    ``lexicon`` has a column phrase and any others; phrases that repeat count for each row. The keys have
    to be unique. Null texts and empty phrases hold nothing. Hashes have 64 bits; collisions are ignored.
    """
    known = prepared(lexicon)
    told = known.agg(F.array_sort(F.collect_set("k")).alias("ks"), F.coalesce(F.max("first"), F.lit(False)).alias("first"), F.coalesce(F.max("last"), F.lit(False)).alias("last")).first()
    edges, bits, firsts = told["first"] or told["last"], _bitmap(known, "h"), _bitmap(known, "f")
    lengths = F.array(*(F.lit(k) for k in told["ks"])) if told["ks"] else F.expr("cast(array() as array<int>)")
    cut = texts.select(F.col(key).alias("_key"), pieces(F.col(text_col)).alias("p"))
    if edges:  # whether the pieces before and behind are words
        cut = cut.withColumn("w", F.transform("p", lambda x: x.rlike(r"(?U)\A\w")))
        beside = lambda i, k: [F.coalesce(F.get("w", i - 2), F.lit(False)).alias("before"), F.coalesce(F.get("w", i + k - 1), F.lit(False)).alias("behind")]
    else:
        beside = lambda i, k: []
    starts = F.filter(F.when(F.size("p") > 0, F.sequence(F.lit(1), F.size("p"))).otherwise(F.expr("cast(array() as array<int>)")), lambda i: _in(firsts, F.xxhash64(F.get("p", i - 1))))
    runs = lambda i: F.transform(F.filter(lengths, lambda k: i + k - 1 <= F.size("p")), lambda k: F.struct(F.xxhash64(F.slice("p", i, k)).alias("h"), i.alias("i"), *beside(i, k)))
    held = F.filter(F.flatten(F.transform(starts, runs)), lambda g: _in(bits, g["h"]))
    found = cut.select("_key", F.inline(held))
    phrases = known.select("h", "k", "first", "last", "again").distinct()
    met = found.join(phrases, "h")
    if edges:
        met = met.where("not (first and before) and not (last and behind)")
    each = met.groupBy("_key", "h", "k").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("again"), F.col("i")))).alias("at"))
    # of a phrase that can overlap itself each place counts that begins behind the last one counted
    step = lambda acc, i: F.when(i >= acc["end"], F.struct((i + F.col("k")).alias("end"), (acc["n"] + 1).alias("n"))).otherwise(acc)
    apart = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])
    each = each.select("_key", "h", F.when(F.size("at") > 0, apart).otherwise(F.col("n")).alias("n"))
    return each.join(known.drop("f", "k", "first", "last", "again"), "h").select(F.col("_key").alias(key), *lexicon.columns, "n")


def table(spark, kinds: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """(kind, entry, place, phrase) of lexicons by kind: entries, in order, with their forms."""
    rows = [(kind, entry, place, phrase) for kind, entries in kinds.items() for place, (entry, forms) in enumerate(entries.items()) for phrase in forms]
    return spark.createDataFrame(rows, "kind string, entry string, place int, phrase string")


def annotate(chunks: DataFrame, lexicon: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """Adds ``counts``, a map from kind to the number of its phrases, and ``mentioned``, a map from kind to its entries in the lexicon's order.

    ``lexicon`` is a ``table``. Kinds that a text doesn't hold aren't in its maps.
    """
    n = phrase_counts(chunks, lexicon, key=key, text_col=text_col).groupBy(key, "kind", "entry", "place").agg(F.sum("n").alias("n"))
    by = n.groupBy(key, "kind").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("entries"))
    maps = by.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"), F.map_from_entries(F.collect_list(F.struct("kind", "entries"))).alias("mentioned"))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(map() as map<string,{kind}>)"))
    return chunks.join(maps, key, "left").withColumns({"counts": none(F.col("counts"), "bigint"), "mentioned": none(F.col("mentioned"), "array<string>")})
