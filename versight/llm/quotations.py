"""Quotation linking: messages without quotes, ordered by what they reply to. Built-in functions only.

A line's quote level is the number of ``>`` it starts with (blanks between are allowed).
Runs of consecutive lines of one level are passages. Normalised passages and lines (A-Z
lower-cased, white space as single blanks, with a letter or digit) are hashed, and
hashes of quotes are joined, within a conversation, to the *first* message that says the
same without a quote: originals are aggregated to one row for each hash first, so a line
that everybody repeats costs one row and no pairs. A message replies to the latest of the
earlier messages that its passages quote at the lowest level that links. Roots and depths follow by pointer
doubling over replies, each round written, so the number of rounds is the logarithm of the
deepest thread; messages are never gathered by conversation.

Conversations are built by ``reply_ordered``: rows sorted by (conversation, root, turn) over
range partitions, so a conversation of any size is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from versight.llm.shared import let, written

# possessive: a run of a million marks needs no stack
MARK = r"\A(?:[\x20\x09]*+>)++[\x20\x09]?"
#: The line that introduces a quote.
INTRODUCTION = r"(?i)\A[\x20\x09]*(?:on\x20.+\x20wrote|am\x20.+\x20schrieb.*|le\x20.+\x20a\x20écrit|el\x20.+\x20escribió)[\x20\x09]*:[\x20\x09\x0D]*\z"
#: A passage needs a word.
WORD = r"[\p{L}\p{N}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """array<struct<level, line>>; introductions of a quote have level -1."""
    split = F.transform(F.split(text, "\n", -1), lambda x: let(F.regexp_extract(x, MARK, 0), lambda m: F.struct((F.length(m) - F.length(F.replace(m, F.lit(">"), F.lit("")))).alias("level"), F.substr(x, F.length(m) + 1).alias("line"))))
    intro = lambda all_: F.transform(all_, lambda x, i: F.when((x["level"] == 0) & (F.coalesce(F.get(all_, i + 1)["level"], F.lit(0)) > 0) & x["line"].rlike(INTRODUCTION), F.struct(F.lit(-1).alias("level"), x["line"].alias("line"))).otherwise(x))
    return let(split, intro)


def _passages(lines: Column) -> Column:
    """array<struct<level, text>>: runs of lines of one level; a blank line ends a run without quotes."""

    def starts(n: Column) -> Column:
        first = F.filter(
            F.transform(n, lambda x, i: F.when((x["line"] != "") & ((i == 0) | (F.get(n, i - 1)["level"] != x["level"]) | (F.get(n, i - 1)["line"] == "")), i)),
            lambda i: i.isNotNull(),
        )
        run = lambda f: F.transform(f, lambda i, k: F.struct(F.get(n, i)["level"].alias("level"), F.trim(F.array_join(F.transform(F.slice(n, i + 1, F.coalesce(F.get(f, k + 1), F.size(n)) - i), lambda x: F.when(x["level"] == F.get(n, i)["level"], x["line"]).otherwise("")), " ")).alias("text")))
        return let(first, run)

    normal = F.transform(lines, lambda x: F.struct(x["level"].alias("level"), _normal(x["line"]).alias("line")))
    runs = lambda n: F.concat(F.transform(starts(n), lambda x: F.struct(x["level"].alias("level"), F.regexp_replace(x["text"], " +", " ").alias("text"))), F.transform(n, lambda x: F.struct(x["level"].alias("level"), x["line"].alias("text"))))
    return let(normal, runs)


def _rooted(replies: DataFrame) -> DataFrame:
    """(conv, turn, parent) with root and depth, by pointer doubling."""
    now = written(replies.select("_c", "_t", F.col("_p").alias("_a"), F.lit(1).cast("long").alias("_depth")), "replies")
    while True:
        up = now.select(F.col("_c").alias("_uc"), F.col("_t").alias("_ut"), F.col("_a").alias("_ua"), F.col("_depth").alias("_ud"))
        met = now.join(up, (F.col("_c") == F.col("_uc")) & (F.col("_a") == F.col("_ut")), "left")
        now = written(met.select("_c", "_t", F.coalesce("_ua", "_a").alias("_a"), (F.col("_depth") + F.coalesce("_ud", F.lit(0))).alias("_depth"), F.col("_ua").isNotNull().alias("_moved")), "replies")
        if now.where("_moved").isEmpty():
            return now.select("_c", "_t", F.col("_a").alias("_root"), "_depth")
        now = now.drop("_moved")


def link_quotations(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", min_words: int = 1) -> DataFrame:
    """One row per message: its ids and role, clean_text, formatted, n_quotes, max_level, parent_turn, root_turn, depth.

    Ordered by (conversation, root_turn, turn), threads stand together and each message
    after the one it replies to; the rows are not sorted here. Messages without a known
    quote are roots of depth 0. Null texts count as empty; messages with a null
    conversation or turn link with nothing, and their root is their own turn. Rows that
    repeat a (conversation, turn) repeat with the same links. An empty table gives an
    empty result. Only the named columns are read.
    """
    text = F.coalesce(F.col("_x"), F.lit(""))
    rows = messages.select(F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.col(role_col).alias("_r"), F.col(text_col).alias("_x"))
    lines = rows.select("_c", "_t", "_r", let(_lines(text), lambda a: F.struct(a.alias("lines"), F.exists(a, lambda x: x["level"] > 0).alias("quotes"))).alias("l"))
    quoting = lines.where("l.quotes and _c is not null and _t is not null").select("_c", "_t", F.explode(_passages(F.col("l.lines"))).alias("p")).where(f"p.level > 0 and size(split(p.text, ' ')) >= {min_words}").where(F.col("p.text").rlike(WORD))
    quoted = written(quoting.select("_c", "_t", "p.level", F.md5("p.text").alias("_h")).distinct(), "quotes")
    clean = F.trim(F.array_join(F.transform(F.filter("l.lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))
    levels = F.transform("l.lines", lambda x: F.greatest(x["level"], F.lit(0)))
    runs = F.size(F.filter(F.transform(levels, lambda x, i: (x > 0) & ((i == 0) | (F.get(levels, i - 1) != x))), lambda x: x))
    shown = lines.select("_c", "_t", "_r", F.when(F.col("l.quotes"), clean).otherwise(F.trim(F.array_join(F.transform("l.lines", lambda x: x["line"]), "\n"), F.lit(" \t\r\n"))).alias("clean_text"), F.when(F.col("l.quotes"), runs).otherwise(0).cast("long").alias("n_quotes"), F.when(F.col("l.quotes"), F.array_max(levels)).otherwise(0).cast("long").alias("max_level"))
    if quoted.isEmpty():  # no links: no shuffle
        out = shown.select("*", F.lit(None).cast("long").alias("_p"), F.lit(None).cast("long").alias("_root"), F.lit(None).cast("long").alias("_depth"))
    else:
        wanted = quoted.select("_c").distinct()
        said = lines.where("_c is not null and _t is not null").join(written(wanted, "conversations"), "_c", "left_semi")
        said = said.select("_c", "_t", F.explode(_passages(F.col("l.lines"))).alias("p")).where(f"p.level = 0 and size(split(p.text, ' ')) >= {min_words}").where(F.col("p.text").rlike(WORD))
        first = said.groupBy("_c", F.md5("p.text").alias("_h")).agg(F.min("_t").alias("_o"))
        linked = quoted.join(first, ["_c", "_h"]).where("_o < _t")
        replies = linked.groupBy("_c", "_t").agg(F.max_by("_o", F.struct(-F.col("level"), "_o")).alias("_p"))
        replies = written(replies, "parents")
        out = shown.join(replies, ["_c", "_t"], "left").join(_rooted(replies), ["_c", "_t"], "left")
    return out.select(
        F.col("_c").alias(conv_col),
        F.col("_t").alias(turn_col),
        F.col("_r").alias(role_col),
        "clean_text",
        F.concat(F.lit("<|"), F.coalesce("_r", F.lit("user")), F.lit("|>\n"), "clean_text").alias("formatted"),
        "n_quotes",
        "max_level",
        F.col("_p").cast("long").alias("parent_turn"),
        F.coalesce(F.col("_root"), F.col("_t")).cast("long").alias("root_turn"),
        F.coalesce(F.col("_depth"), F.lit(0)).cast("long").alias("depth"),
    )


def reply_ordered(linked: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """The rows of ``link_quotations`` as conversations: threads one after another, each message after what it replies to.

    Rows are dealt by ranges of (conversation, root_turn, turn) and sorted; written files
    keep that order. A conversation that holds a third of all rows spans many ranges.
    Null conversations and turns come first; repeated rows stand together.
    """
    keys = [conv_col, "root_turn", turn_col]
    return linked.repartitionByRange(*keys).sortWithinPartitions(*keys, "depth")


def oracle() -> str:
    """DuckDB SQL for the query: passages as text, first sayers, and a recursive walk up the replies."""
    q = lambda s: s.replace("'", "''")
    mark = MARK.replace("*+", "*").replace(")++", ")+")
    ends = "' ' || chr(9) || chr(13) || chr(10)"
    return rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
split AS (SELECT rid, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM m),
marked AS (SELECT rid, i, raw, regexp_extract(raw, '{mark}') AS mark FROM split),
lv AS (SELECT rid, i, length(mark) - length(replace(mark, '>', '')) AS level, substr(raw, length(mark) + 1) AS line FROM marked),
l AS (SELECT rid, i, CASE WHEN level = 0 AND lead(level) OVER (PARTITION BY rid ORDER BY i) > 0 AND regexp_matches(line, '{q(INTRODUCTION)}') THEN -1 ELSE level END AS level, line,
  trim(regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '[ 	-
]+', ' ', 'g')) AS norm FROM lv),
b AS (SELECT *, norm <> '' AND (lag(level) OVER w IS NULL OR lag(level) OVER w <> level OR lag(norm) OVER w = '') AS start, greatest(level, 0) > 0 AND coalesce(greatest(lag(level) OVER w, 0) <> greatest(level, 0), true) AS quote FROM l WINDOW w AS (PARTITION BY rid ORDER BY i)),
runs AS (SELECT *, sum(start::int) OVER (PARTITION BY rid ORDER BY i) AS run FROM b),
pass AS (SELECT rid, max(level) FILTER (norm <> '') AS level, string_agg(norm, ' ' ORDER BY i) FILTER (norm <> '') AS txt FROM runs WHERE run > 0 GROUP BY rid, run
  UNION SELECT rid, level, norm FROM l WHERE norm <> ''),
p AS (SELECT DISTINCT conv_id, turn, level, txt FROM pass JOIN m USING (rid) WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(txt, '{WORD}')),
said AS (SELECT conv_id, txt, min(turn) AS o FROM p WHERE level = 0 GROUP BY ALL),
parents AS (SELECT conv_id, turn, arg_max(o, -level * 1e9 + o) AS parent FROM p JOIN said USING (conv_id, txt) WHERE level > 0 AND o < turn GROUP BY ALL),
up AS (SELECT conv_id, turn, parent AS top, 1 AS depth FROM parents UNION ALL SELECT up.conv_id, up.turn, r.parent, depth + 1 FROM up JOIN parents r ON up.conv_id = r.conv_id AND up.top = r.turn),
roots AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(top, depth) AS root FROM up GROUP BY ALL),
shown AS (SELECT rid, max(level) > 0 AS quotes, trim(string_agg(line, chr(10) ORDER BY i), {ends}) AS whole, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), {ends}), '') AS own, sum(quote::int) AS n, greatest(max(level), 0) AS deepest FROM b GROUP BY rid),
out AS (SELECT m.*, CASE WHEN quotes THEN own ELSE whole END AS clean_text, n, deepest FROM m JOIN shown USING (rid))
SELECT conv_id, turn, role, clean_text, '<|' || coalesce(role, 'user') || '|>' || chr(10) || clean_text AS formatted, n::bigint AS n_quotes, deepest::bigint AS max_level,
  parent::bigint AS parent_turn, coalesce(root, turn)::bigint AS root_turn, coalesce(depth, 0)::bigint AS depth
FROM out LEFT JOIN parents USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn)
"""
