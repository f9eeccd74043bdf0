"""Books to chapters to annotated, overlapping chunks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from versight import lexicons as L
from versight.functions import text as T
from versight.functions.ranges import running

HEADING = r"(?i)^\s*chapter\s+([0-9]+|[ivxlcdm]+)\.?\s*(?:[-:.]\s*)?(.*\S)?\s*$"
START = r"(?i)\*\*\*\s*START OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*\*\*"
END = r"(?i)\*\*\*\s*END OF (?:THE )?PROJECT GUTENBERG EBOOK.*?\*\*\*"
#: Each word has its edge, so that the repetition needs no way back: a possessive one takes no stack, however many words follow.
CAPITALISED = r"[A-Z](?<=\b[A-Z])[a-z]+\b(?:\s+(?:of|the|de|du|da|del|[A-Z][a-z]+)\b)*+"
_SPEECH = "|".join(L.SPEECH)
#: A letter that may begin one comes first, the word's edge last: most places fail at the letter.
SPEECH = rf"(?i)[{''.join(dict.fromkeys(w[0] for w in L.SPEECH))}](?:{'|'.join(w[1:] for w in L.SPEECH)})(?<=\b(?:{_SPEECH}))\b"
QUOTES = ('"', "\u201c", "\u201d")


def strip_boilerplate(text: Column) -> Column:
    """Text between the start and the end marker, trimmed. The end's place is that in the whole
    text, and is applied to what follows the start marker, as the data's makers do."""
    head = F.regexp_instr(text, F.lit(START))
    cut = F.when(head > 0, F.substring(text, head + F.length(F.regexp_extract(text, START, 0)), F.length(text))).otherwise(text)
    tail = F.regexp_instr(text, F.lit(END))
    return F.trim(F.when(tail > 0, F.left(cut, tail - 1)).otherwise(cut), F.lit(" \t\r\n\x0b\x0c"))


def heading_title(head: Column) -> tuple[Column, Column]:
    """(what a heading line says behind its number, whether that is no title)."""
    trailing = F.trim(F.regexp_extract(head, HEADING, 2), F.lit(" .:-"))
    return trailing, (trailing == "") | trailing.rlike(HEADING)


def titled(line: Column) -> Column:
    """Whether a line looks like a title: 1 to 12 words, at most 100 characters, mostly capitals or each word with one. Null for longer lines, which so aren't searched."""
    line = F.when(F.length(line) <= 100, line)
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.size(F.regexp_extract_all(line, F.lit("[A-Za-z0-9']+"), F.lit(0))).between(1, 12)) & (letters != "") & ((F.regexp_count(letters, F.lit(r"\p{Lu}")) * 4 >= F.length(letters) * 3) | (F.initcap(line) == line))


def ids(book: Column, chapter: Column, chunk: Column) -> tuple[Column, Column]:
    """(chapter_id, chunk_id) of a chapter's number and a chunk's from 0."""
    chapter_id = F.format_string("%s:ch%04d", T.slug(book.cast("string")), chapter.cast("int"))
    return chapter_id, F.concat(chapter_id, F.format_string(":chunk%04d", (chunk + 1).cast("int")))


def chapters(books: DataFrame, *, key: str = "book_name", text_col: str = "text") -> DataFrame:
    """(key, chapter_index, chapter_title, text): sections that begin at heading lines.

    No heading: one chapter without a title. What precedes the first heading is dropped; a
    heading that is only a number takes the first line after it if that looks like a title;
    empty bodies take no number. Lines are exploded and put together again per chapter.
    """
    clean = books.select(F.col(key).alias("_k"), strip_boilerplate(F.coalesce(F.col(text_col), F.lit(""))).alias("_x")).where("_x != ''")
    lines = clean.select("_k", F.posexplode(F.split("_x", r"\r\n|\r|\n")).alias("p", "line")).withColumn("h", F.trim("line").rlike(HEADING))
    by_book = W.partitionBy("_k").orderBy("p")
    lines = lines.withColumn("c", F.sum(F.col("h").cast("int")).over(by_book)).withColumn("any", F.max("h").over(W.partitionBy("_k")))
    body = lines.where("c > 0 or not any")
    parts = body.groupBy("_k", "c").agg(
        F.max(F.when(F.col("h"), F.trim("line"))).alias("head"),
        F.min(F.when(~F.col("h") & (F.trim("line") != ""), F.struct("p", "line"))).alias("next"),
        F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("p", "line")))).alias("ls"),
    )
    trailing, generic = heading_title(F.col("head"))
    candidate = F.trim(F.col("next.line"))
    use = F.coalesce(generic & titled(candidate), F.lit(False))
    kept = F.filter("ls", lambda x: ~use | (x["p"] > F.col("next.p")))
    made = parts.select("_k", "c", F.when(F.col("head").isNull(), F.lit(None)).when(use, candidate).when(trailing != "", trailing).otherwise(F.col("head")).alias("chapter_title"), F.trim(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"), F.lit(" \t\r\n\x0b\x0c")).alias("text"))
    made = made.where("text != ''")
    return made.select(F.col("_k").alias(key), F.row_number().over(W.partitionBy("_k").orderBy("c")).alias("chapter_index"), "chapter_title", "text")


def chunk_array(text: Column, size: int = 400, overlap: int = 100, tail: str = "stop") -> Column:
    """Overlapping chunks of words. ``stop`` ends with the chunk that reaches the end; ``emit`` goes on while a step begins before it."""
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap smaller")
    # words move in pieces of as many as both numbers are a multiple of
    unit = math.gcd(size, overlap)
    size, overlap, emit = size // unit, overlap // unit, tail != "stop"
    pieces = F.regexp_extract_all(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(rf"[^ ]++(?: [^ ]++){{0,{unit - 1}}}+"), F.lit(0))

    def cut(p: Column) -> Column:
        n = F.size(p)
        last = n - 1 if emit else F.greatest(n - overlap - 1, F.lit(0))
        chunks = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda i: F.array_join(F.slice(p, i + 1, size), " "))
        return F.when(n > 0, chunks).otherwise(F.expr("cast(array() as array<string>)"))

    return F.get(F.transform(F.array(pieces), cut), F.lit(0))


def build_chunks(chapters_df: DataFrame, *, book: str = "book_name", chapter: str = "chapter_index", text_col: str = "text", size: int = 400, overlap: int = 100, global_index: bool = True) -> DataFrame:
    """One row per chunk with its ids and indices.

    ``chunk_index_global`` runs over all books in their order; numbers are offsets of
    per-chapter counts. Chapters are dealt by ranges of (book, chapter); sums run within a
    range and ranges are offset by their totals, so no task sees all chapters.
    """
    own = chapters_df.select(F.col(book).alias("book_name"), F.col(chapter).alias("chapter_index"), *(["chapter_title"] if "chapter_title" in chapters_df.columns else [F.lit(None).cast("string").alias("chapter_title")]), F.col(text_col).alias("text"))
    if global_index:
        sizes = own.select("book_name", "chapter_index", _chunk_count(F.col("text"), size, overlap).alias("n")).groupBy("book_name", "chapter_index").agg(F.sum("n").alias("n"))
        offsets = running(sizes.where("n > 0"), ["book_name", "chapter_index"], {"up_to": F.col("n")}).select("book_name", "chapter_index", (F.col("up_to") - F.col("n")).alias("before"))
        own = own.join(offsets, ["book_name", "chapter_index"])  # before they are cut: a text moves once, without what chunks share
    places = ["before"] if global_index else []
    chunks = own.select("book_name", "chapter_index", "chapter_title", *places, F.posexplode(chunk_array(F.col("text"), size, overlap)).alias("i", "text"))
    chapter_id, chunk_id = ids(F.col("book_name"), F.col("chapter_index"), F.col("i"))
    at = (F.col("i") + 1).alias("chunk_index_in_chapter")
    return chunks.select("book_name", chapter_id.alias("chapter_id"), "chapter_title", at, chunk_id.alias("chunk_id"), "text", *((F.col(p) + F.col("i") + 1).alias("chunk_index_global") for p in places))


def _chunk_count(text: Column, size: int, overlap: int) -> Column:
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))  # as many as T.words has
    return T.let(n, lambda n: F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(size - overlap)) + 1))


def chunk_counts(books: DataFrame, *, book: str = "book_name", text_col: str = "text", size: int = 400, overlap: int = 100) -> DataFrame:
    """(book, n_chunks): counted from the numbers of words; no chunk is made."""
    return books.groupBy(book).agg(F.sum(_chunk_count(F.col(text_col), size, overlap)).cast("long").alias("n_chunks")).where("n_chunks > 0")


def _hits(text: Column, forms: dict[str, tuple], plain: Column | None) -> Column:
    """Names of ``forms`` of which a form occurs as a whole phrase, in their order."""
    found = lambda p: F.filter(F.array(*(F.when(T.any_phrase(text, own, p), name) for name, own in forms.items())), lambda x: x.isNotNull())
    return T.let(T.plain(text), found) if plain is None else found(plain)


def mentions(text: Column, names=L.CHARACTERS, plain: Column | None = None) -> Column:
    """Names that occur as whole phrases, in the lexicon's order. ``plain`` is ``T.plain(text)``, where it is a column already."""
    return _hits(text, {n: (n,) for n in names}, plain)


def event_mentions(text: Column, events=L.EVENTS, plain: Column | None = None) -> Column:
    return _hits(text, events, plain)


def _total(text: Column, phrases, plain: Column) -> Column:
    out = F.lit(0)
    for p in phrases:
        out = out + T.phrase_count(text, p, plain)
    return out


def dialogue_markers(text: Column, plain: Column) -> Column:
    """Quotation marks, and words of speech; a text is searched for these only if its plain form has the letters of one."""
    quotes = sum(((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(q), F.lit("")))) / len(q.encode()) for q in QUOTES), F.lit(0))
    said = reduce(lambda a, b: a | b, (F.contains(plain, F.lit(w)) for w in L.SPEECH))
    return (quotes + F.when(said, F.regexp_count(text, F.lit(SPEECH))).otherwise(0)).cast("int")


def density_features(text: Column, characters=L.CHARACTERS, events=L.EVENTS, temporal=L.TEMPORAL, plain: Column | None = None) -> Column:
    """Five counts; a form that belongs to several events counts for each. ``plain`` as for ``mentions``."""
    if plain is None:
        return T.let(T.plain(text), lambda p: density_features(text, characters, events, temporal, p))
    capitals = F.filter(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0)), lambda x: F.length(x) > 1)
    return F.struct(
        _total(text, characters, plain).cast("int").alias("character_mention_count"),
        _total(text, [f for forms in events.values() for f in forms], plain).cast("int").alias("event_mention_count"),
        _total(text, temporal, plain).cast("int").alias("temporal_marker_count"),
        F.size(capitals).cast("int").alias("capitalized_phrase_count"),
        dialogue_markers(text, plain).alias("dialogue_marker_count"),
    )


def density_score(f: Column) -> Column:
    return F.round(2 * f["character_mention_count"] + 1.5 * f["event_mention_count"] + 1.0 * f["temporal_marker_count"] + 0.5 * f["capitalized_phrase_count"] + 0.75 * f["dialogue_marker_count"], 3)


def annotate(chunks: DataFrame, characters=L.CHARACTERS, events=L.EVENTS, temporal=L.TEMPORAL) -> DataFrame:
    text, plain = F.col("text"), F.col("_plain")
    made = chunks.withColumn("_plain", T.plain(text)).withColumns({"character_mentions": mentions(text, characters, plain), "event_mentions": event_mentions(text, events, plain), "metadata": density_features(text, characters, events, temporal, plain)})
    return made.drop("_plain").withColumn("plot_density_score", density_score(F.col("metadata")))


def substring_flags(text: Column, words, prefix: str) -> list[Column]:
    """A 0/1 column for each word that is part of the text, as raw substring."""
    return [F.contains(F.lower(text), F.lit(w.lower())).cast("int").alias(prefix + w.lower().replace(" ", "_").replace("-", "_")) for w in words]


def records(chunks: DataFrame) -> DataFrame:
    """Annotated chunks with the fields of a chunk file, in their order."""
    path = F.col("source_path") if "source_path" in chunks.columns else F.lit(None).cast("string")
    return chunks.select("chunk_id", "book_name", "chapter_id", "chapter_title", "chunk_index_global", "chunk_index_in_chapter", "text", "character_mentions", "event_mentions", "plot_density_score", path.alias("source_path"), "metadata")


def split_chapters(text: Column, spark_rows: DataFrame | None = None, *, key: str = "book_name") -> DataFrame:
    """(key, title, text) of the chapters of rows whose ``text`` column is given; see ``chapters``."""
    if spark_rows is None:
        raise ValueError("the rows that hold the text are needed")
    return chapters(spark_rows.withColumn("_text", text), key=key, text_col="_text").select(key, "chapter_index", "chapter_title", "text")


def chunk_words(text: Column, chunk_size: int = 400, chunk_overlap: int = 100) -> Column:
    """``chunk_array`` under the names that older callers use."""
    return chunk_array(text, chunk_size, chunk_overlap)
