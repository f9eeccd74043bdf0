"""Line-first cleaning with built-in functions only.

Rules are evaluated on each line; failing lines are removed, and a document that
loses more than ``max_lost_percent`` of its word characters is rejected. Everything is
an expression over one row: no shuffle, no Python, and work that grows with the length
of the text (times its logarithm where windows are sorted).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from versight.llm.shared import let

WORD = r"[^\x20\x09-\x0D]+"
#: A word that ends a sentence, at the end of a word.
SENTENCE_END = r"[.!?:;…。！？](?:[\x22\x27)\]»”’]*)(?:[\x20\x09-\x0D]|\z)"
#: A word that only separates menu entries.
SEPARATOR = r"(?:^|[\x20\x09-\x0D])(?:[|•·»>/]+)(?:[\x20\x09-\x0D]|\z)"
SYMBOL_WORD = r"[#*$%&|<>{}\\^~][^\x20\x09-\x0D]*"
SHOUT = r"[!?](?:[\x20\x09-\x0D]|\z)"
#: Phrases of notices, at most in lines of ``notice_words`` words.
NOTICE = r"(?i)(?:cookie|privacy policy|terms of (?:use|service)|all rights reserved|licen[sc]ed under|under the [a-z0-9 ]+ licen[sc]e|enable javascript|sign (?:in|up)|log ?in|subscribe|click here|read more|share (?:on|this)|copyright|©)"


@dataclass(frozen=True)
class LineRules:
    """Thresholds in percent of a line's words, and of a document's word characters."""

    separator_percent: int = 20
    symbol_percent: int = 30
    shout_percent: int = 40
    stutter_percent: int = 50
    notice_words: int = 20
    max_lost_percent: int = 50


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(text).cast("long") - _count(text, r"[\x20\x09-\x0D]")


def repeated_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more: windows are compared by 64-bit
    hashes; sorted hashes show whether any repeats, and only then positions are sorted too."""
    eight = [F.lit(k) for k in range(8)]

    def covered(windows: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def marked(s: Column) -> Column:
            same = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())
            start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-8).alias("last"))
            step = lambda acc, p: F.struct((acc["total"] + F.least(F.lit(8), p - acc["last"])).alias("total"), p.alias("last"))
            return F.aggregate(F.sort_array(same), start, step, lambda acc: acc["total"])

        return let(F.sort_array(at), marked)

    def from_windows(windows: Column) -> Column:
        repeats = let(F.sort_array(windows), lambda s: F.exists(F.transform(s, lambda x, k: F.coalesce(x == F.get(s, k - 1), F.lit(False))), lambda x: x))
        return F.when(repeats, covered(windows)).otherwise(F.lit(0).cast("long"))

    def from_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - 8), lambda i: F.xxhash64(*(F.get(h, i + k) for k in eight)))
        return F.when(F.size(h) < 9, F.lit(0).cast("long")).otherwise(let(windows, from_windows))

    return let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes)


def line_fails(line: Column, rules: LineRules) -> Column:
    """The name of the first rule that a line with words fails, or null."""
    n = _count(line, WORD)

    def named(n: Column) -> Column:
        words = F.split(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")), " ")
        stutter = lambda w: F.size(F.filter(F.transform(w, lambda x, k: F.coalesce(x == F.get(w, k - 1), F.lit(False))), lambda x: x))
        return (
            F.when(_count(line, SEPARATOR) * 100 >= n * rules.separator_percent, "navigation")
            .when(_count(line, SYMBOL_WORD) * 100 > n * rules.symbol_percent, "symbols")
            .when((n >= 4) & (_count(line, SHOUT) * 100 > n * rules.shout_percent), "shouting")
            .when(~line.rlike(SENTENCE_END), "punctuation")
            .when((n <= rules.notice_words) & line.rlike(NOTICE), "boilerplate")
            .when((n >= 4) & (let(words, stutter) * 100 > n * rules.stutter_percent), "stutter")
        )

    return let(n, named)


def measures(text: Column, rules: LineRules) -> Column:
    """One struct of everything that is measured on a text."""

    def lines_of(lines: Column) -> Column:
        judged = F.transform(lines, lambda x: F.struct(x.alias("line"), word_chars(x).alias("chars")))
        judged = F.transform(judged, lambda x: F.struct(x["line"].alias("line"), x["chars"].alias("chars"), F.when(x["chars"] > 0, line_fails(x["line"], rules)).alias("fails")))

        def summary(j: Column) -> Column:
            add = lambda acc, x: F.struct(
                (acc["n_lines"] + F.when(x["chars"] > 0, 1).otherwise(0)).alias("n_lines"),
                (acc["n_failed_lines"] + F.when(x["fails"].isNotNull(), 1).otherwise(0)).alias("n_failed_lines"),
                (acc["lost_chars"] + F.when(x["fails"].isNotNull(), x["chars"]).otherwise(0)).alias("lost_chars"),
                (acc["word_chars"] + x["chars"]).alias("word_chars"),
            )
            zero = F.struct(*(F.lit(0).cast("long").alias(k) for k in ("n_lines", "n_failed_lines", "lost_chars", "word_chars")))
            worded = F.transform(F.filter(j, lambda x: x["chars"] > 0), lambda x: x["line"])
            return F.struct(
                F.aggregate(j, zero, add).alias("sums"),
                let(worded, lambda w: (F.size(w) - F.size(F.array_distinct(w))).cast("long")).alias("n_dup_lines"),
                F.array_join(F.transform(F.filter(j, lambda x: x["fails"].isNull()), lambda x: x["line"]), "\n").alias("clean_text"),
            )

        return let(judged, summary)

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.struct(
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(F.split(text, "\n", -1), lines_of).alias("l"),
        _count(text, r"[#*$%&|<>]").alias("n_symbols"),
    )


def _values(m: Column, rules: LineRules) -> dict[str, Column]:
    base_failed = (m["w"]["n_words"] < 20) | (m["w"]["n_repeat_words"] * 100 > m["w"]["n_words"] * 30)
    lost, chars = m["l"]["sums"]["lost_chars"], m["l"]["sums"]["word_chars"]
    return {
        "n_words": m["w"]["n_words"],
        "word_chars": chars,
        "n_symbols": m["n_symbols"],
        "n_dup_lines": m["l"]["n_dup_lines"],
        "n_repeat_words": m["w"]["n_repeat_words"],
        "base_failed": base_failed,
        "kept": ~base_failed & (lost * 100 <= chars * rules.max_lost_percent),
        "n_lines": m["l"]["sums"]["n_lines"],
        "n_failed_lines": m["l"]["sums"]["n_failed_lines"],
        "lost_chars": lost,
        "clean_text": m["l"]["clean_text"],
    }


def clean_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The id, the base measures, the cleaned text and the verdict of each row.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_lines (with a word), n_failed_lines, lost_chars, clean_text (the text without
    failing lines; null for null). A line without a word is neither judged nor removed.
    Null texts count as empty, and empty ones fail the base rule. Null ids are carried,
    repeated rows repeat, an empty table gives an empty result, and only the two named
    columns are read, so others may have any names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    measured = rows.select("_id", "_text", measures(F.coalesce(F.col("_text"), F.lit("")), rules).alias("_m"))
    values = _values(F.col("_m"), rules)
    values["clean_text"] = F.when(F.col("_text").isNotNull(), values["clean_text"])
    return measured.select(F.col("_id").alias(id_col), *(c.alias(k) for k, c in values.items()))


def keep_clean(docs: DataFrame, *, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their cleaned texts; the other columns stay.

    The verdict filters inside a generator, so that it is computed once and not again in
    a filter that is pushed down. Rejected rows, null and empty texts go.
    """
    judged = let(measures(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), rules), lambda m: F.struct(_values(m, rules)["kept"].alias("kept"), m["l"]["clean_text"].alias("clean")))
    found = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0)) + "verdict"  # no column of the input
    kept = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.explode(F.filter(F.array(judged), lambda x: x["kept"])).alias(found))
    return kept.select(*(F.col(f"{found}.clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def oracle(rules: LineRules = LineRules()) -> str:
    """DuckDB SQL for the query: the same rules, windows compared by their words."""
    q = lambda p: p.replace("'", "''")
    n = lambda x, p: f"len(regexp_extract_all({x}, '{q(p)}'))"
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
win2 AS (SELECT r, i, list_slice(ws, i, i + 7) AS g FROM win),
dup AS (SELECT r, g FROM win2 GROUP BY r, g HAVING count(*) > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win2 SEMI JOIN dup USING (r, g)) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT r, line, {n("line", WORD)} AS n, length(line) - {n("line", blank)} AS chars FROM l0),
l2 AS (SELECT r, line, n, chars, CASE
  WHEN n = 0 THEN false
  WHEN {n("line", SEPARATOR)} * 100 >= n * {rules.separator_percent} THEN true
  WHEN {n("line", SYMBOL_WORD)} * 100 > n * {rules.symbol_percent} THEN true
  WHEN n >= 4 AND {n("line", SHOUT)} * 100 > n * {rules.shout_percent} THEN true
  WHEN NOT regexp_matches(line, '{q(SENTENCE_END)}') THEN true
  WHEN n <= {rules.notice_words} AND regexp_matches(line, '{q(NOTICE)}') THEN true
  WHEN n >= 4 AND len(list_filter(range(2, n + 1), lambda k: regexp_extract_all(line, '{WORD}')[k] = regexp_extract_all(line, '{WORD}')[k - 1])) * 100 > n * {rules.stutter_percent} THEN true
  ELSE false END AS fails FROM l1),
l3 AS (SELECT r, sum(chars) AS word_chars, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (fails) AS n_failed_lines,
  coalesce(sum(chars) FILTER (fails), 0) AS lost_chars, count(*) FILTER (n > 0) - count(DISTINCT CASE WHEN n > 0 THEN line END) AS n_dup_lines FROM l2 GROUP BY r),
m AS (SELECT d.doc_id, len(ws) AS n_words, l3.*, {n("text", "[#*$%&|<>]")} AS n_symbols, coalesce(cover.n, 0) AS n_repeat_words,
  len(ws) < 20 OR 100 * coalesce(cover.n, 0) > 30 * len(ws) AS base_failed FROM d JOIN w USING (r) JOIN l3 USING (r) LEFT JOIN cover USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {rules.max_lost_percent} AS kept,
  n_lines::BIGINT AS n_lines, n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars FROM m
"""
