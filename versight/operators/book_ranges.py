"""Chapters and chunks of books of any size, read by byte ranges.

A text file is split into ranges of lines by Spark's reader; ``spark.sql.files.maxPartitionBytes`` is their size. No
book, chapter or order of lines is ever gathered or shuffled. Three passes over the lines, each of which
keeps a few numbers while it streams through a range:

1. where the markers of the front and back matter are, counted in characters from the range's begin;
2. headings, words before the first and behind the last one, and whether a heading at the end still
   waits for a title line: what a range does to whatever chapter is open when it begins;
3. words with their places in the chapter, cut at the chunks' edges, from the state in which the range begins.

Between the passes the ranges (one row each, counted before) are put in order, which gives each
its state: a segmented prefix scan. A chunk that lies in one range is made there; others are put together from a piece a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from versight.functions import text as T
from versight.functions.ranges import running
from versight.functions.store import written
from versight.operators import ingest

#: Ranges whose states are sent to all tasks; more need larger ranges.
MOST_RANGES = 1 << 20


def lines(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """(book, at, line and what is known of it alone) in the order of each range; ``at`` is where its range begins in the file.

    Lines end at a line feed; carriage returns in them divide further. A marker stands on one line.
    """
    rows = spark.read.option("pathGlobFilter", glob).option("lineSep", "\n").text(path)
    name = F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1))
    rows = rows.select(name.alias("book"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))
    ends = lambda pattern: F.when(F.contains("line", F.lit("***")), F.regexp_instr("line", F.lit(pattern)) - 1).otherwise(-1)
    begin = ends(ingest.START)
    return rows.select("book", "at", "line", F.when(begin >= 0, begin + F.length(F.regexp_extract("line", ingest.START, 0))).alias("start"), F.when((end := ends(ingest.END)) >= 0, end).alias("end"))


#: What both engines of patterns take for white space.
_BLANKS = " \t\n\x0b\f\r"


def _parsed(cut: DataFrame) -> DataFrame:
    """Lines with the marks of headings and titles, divided at carriage returns."""
    line = F.col("line")
    divided = F.when(F.contains(line, F.lit("\r")), F.split(F.regexp_replace(line, r"\r\z", ""), "\r")).otherwise(F.array(line))
    part = cut.select("book", "at", F.explode(divided).alias("line"))
    # most lines fail at their first letters
    maybe = F.lower(F.left(F.ltrim(line, F.lit(_BLANKS)), F.lit(7))) == "chapter"
    part = part.withColumn("is_head", maybe & F.trim("line").rlike(ingest.HEADING))
    head, is_head = F.trim("line"), F.col("is_head")
    trailing, generic = ingest.heading_title(head)
    return part.select("book", "at", line.cast("binary").alias("line"), F.when(is_head, head).alias("head"), F.when(is_head, trailing).alias("trailing"), F.coalesce(is_head & generic, F.lit(False)).alias("generic"), F.coalesce(~is_head & (head != "") & ingest.titled(head), F.lit(False)).alias("fits"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """((book, at), (book, at, line, head, trailing, generic, fits) of its lines) of each range of parsed lines, in order."""
    names = ("book", "at", "line", "head", "trailing", "generic", "fits")
    rows = (row for batch in batches for i in range(0, batch.num_rows, 4096) for row in zip(*(batch.column(c).slice(i, 4096).to_pylist() for c in names), strict=True))
    return groupby(rows, key=lambda r: r[:2])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[dict]]]:
    """((book, at), its lines) of each range, in order."""
    rows = (row for batch in batches for i in range(0, batch.num_rows, 4096) for row in batch.slice(i, 4096).to_pylist())
    return groupby(rows, key=lambda r: (r["book"], r["at"]))


def _checked(ranges: DataFrame) -> list:
    n = ranges.count()
    if n > MOST_RANGES:
        raise ValueError(f"{n} ranges; raise spark.sql.files.maxPartitionBytes")
    return sorted(ranges.collect(), key=lambda r: (r["book"], r["at"]))


def _markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters of each range, and the first of either marker, counted from its begin."""
    for (book, at), rows in _streamed(batches):
        size, start, end = 0, None, None
        for r in rows:
            if start is None and r["start"] is not None:
                start = size + r["start"]
            if end is None and r["end"] is not None:
                end = size + r["end"]
            size += r["size"] + 1
        yield pa.RecordBatch.from_pylist([{"book": book, "at": at, "size": size, "start": start, "end": end}], schema=pa.schema([("book", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _kept(found: DataFrame) -> DataFrame:
    """Lines between the markers: behind the first start; the end's place is that in the whole text, counted from the start."""
    has = found.agg(F.count("start").alias("s"), F.count("end").alias("e")).first()
    if not has["s"] and not has["e"]:
        return found.select("book", "at", "line")
    ranges = _checked(written(found.select("book", "at", "start", "end", F.length("line").cast("long").alias("size")).mapInArrow(_markers, "book string, at long, size long, start long, end long"), "markers"))
    spans: dict[tuple[str, int], tuple[int, int]] = {}
    for book, own in groupby(ranges, key=lambda r: r["book"]):
        own, before, begin, end = list(own), 0, None, None
        for r in own:
            if begin is None and r["start"] is not None:
                begin = before + r["start"]
            if end is None and r["end"] is not None:
                end = before + r["end"]
            before += r["size"]
        begin = begin or 0
        last, before = before if end is None else begin + end, 0
        for r in own:
            spans[book, r["at"]] = (begin - before, last - before)
            before += r["size"]
    shared = found.sparkSession.sparkContext.broadcast(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = {}
        for batch in batches:
            books, ats, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for i, key in enumerate(zip(books, ats, strict=True)):
                at, (low, high) = size.get(key, 0), shared.value[key]
                size[key] = at + len(texts[i]) + 1
                if at + len(texts[i]) >= low and at < high:
                    out.append((i, texts[i][max(0, low - at) : high - at]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in out], pa.int64())), batch.column(1).take(pa.array([i for i, _ in out], pa.int64())), pa.array([x for _, x in out], pa.string())], names=["book", "at", "line"])

    return found.select("book", "at", "line").mapInArrow(cut, "book string, at long, line string")


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the chapter that is open when it begins, and what it leaves open."""
    for (book, at), rows in _read(batches):
        heads, first, before, behind, waits = 0, None, 0, 0, None
        for _, _, line, head, _, generic, fits in rows:
            if head is not None:
                heads, behind, waits = heads + 1, 0, generic
                continue
            n = len(line.split())  # at the same characters as ``T.words``
            if not heads:
                if first is None and line.strip(b" "):
                    first = n if fits else -1
                before += n
            else:
                if waits is not None and line.strip(b" "):
                    n, waits = 0 if waits and fits else n, None
                behind += n
        yield pa.RecordBatch.from_pylist([{"book": book, "at": at, "heads": heads, "first": first, "before": before, "behind": behind, "waits": waits}], schema=pa.schema([("book", pa.string()), ("at", pa.int64()), ("heads", pa.int64()), ("first", pa.int64()), ("before", pa.int64()), ("behind", pa.int64()), ("waits", pa.bool_())]))


def _states(ranges: list) -> dict[tuple[str, int], tuple[int, int, bool | None, bool]]:
    """(chapter, words of it so far, whether its heading waits for a title, whether the book has headings) where each range begins."""
    out = {}
    for book, own in groupby(ranges, key=lambda r: r["book"]):
        own = list(own)
        any_head, chapter, words, waits = any(r["heads"] for r in own), 0, 0, None
        for r in own:
            out[book, r["at"]] = (chapter, words, waits, any_head)
            if r["heads"]:
                chapter, words, waits = chapter + r["heads"], r["behind"], r["waits"]
            else:
                words += r["before"]
                if r["first"] is not None and waits is not None:
                    words, waits = words - (r["first"] if waits and r["first"] > 0 else 0), None
    return out


_PIECE = "book string, chapter long, chunk long, start long, n long, text string, whole boolean, head string, trailing string, title string"


@lru_cache(maxsize=1)
def _piece_schema() -> pa.Schema:
    text = pa.string()
    return pa.schema([("book", text), ("chapter", pa.int64()), ("chunk", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("text", text), ("whole", pa.bool_()), ("head", text), ("trailing", text), ("title", text)])


def _pieces(shared, size: int, overlap: int):
    """Headings and title lines of chapters, and of each chunk the words that a range has: ``whole`` where these are all."""
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (book, at), rows in _read(batches):
            chapter, first, waits, any_head = shared.value[book, at]
            # words from place ``first`` of the chapter on, of the chunks from ``chunk`` on
            words, chunk = [], max(0, (first - size) // step + 1)

            def piece(ended: bool) -> None:
                low = max(0, chunk * step - first)
                if not (part := words[low : chunk * step + size - first]):
                    return
                whole = first + low == chunk * step and (ended or len(part) == size)
                out.append({"book": book, "chapter": chapter, "chunk": chunk, "start": first + low, "n": len(part), "text": b" ".join(part), "whole": whole})

            for _, _, line, head, trailing, generic, fits in rows:
                if head is not None:
                    while chunk * step < first + len(words):
                        piece(True)
                        chunk += 1
                    chapter, words, first, chunk, waits = chapter + 1, [], 0, 0, generic
                    out.append({"book": book, "chapter": chapter, "head": head, "trailing": trailing})
                elif chapter or not any_head:
                    own = line.split()
                    if waits is not None and (title := line.strip(b" ")):
                        if waits and fits:
                            out.append({"book": book, "chapter": chapter, "title": title})
                            own = []
                        waits = None
                    words += own
                    while first + len(words) >= chunk * step + size:
                        piece(False)
                        held += size
                        chunk += 1
                        if held > 1 << 17:
                            yield pa.RecordBatch.from_pylist(out, schema=_piece_schema())
                            out, held = [], 0
                    if (gone := chunk * step - first) > 0:
                        words, first = words[gone:], first + gone
                if len(out) > 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=_piece_schema())
                    out, held = [], 0
            while chunk * step < first + len(words):
                piece(False)
                chunk += 1
        yield pa.RecordBatch.from_pylist(out, schema=_piece_schema())

    return run


def book_chunks(spark: SparkSession, path: str, *, size: int = 400, overlap: int = 100, global_index: bool = True) -> DataFrame:
    """The chunks of all .txt files of a folder, as ``ingest.build_chunks`` makes them from ``ingest.chapters``.

    The book's name is the file's without .txt, as in ``io.read_books``. A line has to fit in memory; a book and a chapter don't.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive and overlap smaller")
    parsed = _parsed(_kept(lines(spark, path)))
    effects = written(parsed.mapInArrow(_effects, "book string, at long, heads long, first long, before long, behind long, waits boolean"), "ranges")
    shared = spark.sparkContext.broadcast(_states(_checked(effects)))
    pieces = written(parsed.mapInArrow(_pieces(shared, size, overlap), _PIECE), "pieces")

    told = pieces.groupBy("book", "chapter").agg(F.max("head").alias("head"), F.max("trailing").alias("trailing"), F.max("title").alias("title"), F.count("chunk").alias("n"), F.max(F.col("start") + F.col("n")).alias("n_words"))
    title = F.when(F.col("head").isNull(), F.lit(None)).when(F.col("title").isNotNull(), F.col("title")).when(F.col("trailing") != "", F.col("trailing")).otherwise(F.col("head"))
    name = F.regexp_replace("book", r"\.txt$", "")
    chapters = told.where("n > 0").select("book", "chapter", name.alias("book_name"), title.alias("chapter_title"), F.row_number().over(W.partitionBy("book").orderBy("chapter")).alias("chapter_index"), "n_words")
    chapters = written(chapters, "chapters")

    own = ("book", "chapter", "chunk")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]), " ")
    chunks = pieces.where("whole").select(*own, "n", "text").unionByName(pieces.where("not whole").groupBy(*own).agg(F.sum("n").alias("n"), joined.alias("text")))
    chunks = chunks.where((F.col("chunk") == 0) | (F.col("n") > overlap)).join(chapters, ["book", "chapter"])
    chapter_id, chunk_id = ingest.ids(F.col("book_name"), F.col("chapter_index"), F.col("chunk"))
    out = chunks.select("book_name", chapter_id.alias("chapter_id"), "chapter_title", "chapter_index", (F.col("chunk") + 1).cast("int").alias("chunk_index_in_chapter"), chunk_id.alias("chunk_id"), "text")
    if not global_index:
        return out.drop("chapter_index")
    n = F.when(F.col("n_words") <= size, 1).otherwise(F.ceil((F.col("n_words") - size) / F.lit(size - overlap)) + 1)
    before = running(chapters.select("book_name", "chapter_index", n.alias("n")), ["book_name", "chapter_index"], {"up_to": F.col("n")}).select("book_name", "chapter_index", (F.col("up_to") - F.col("n")).alias("before"))
    return out.join(before, ["book_name", "chapter_index"]).withColumn("chunk_index_global", F.col("before") + F.col("chunk_index_in_chapter")).drop("before", "chapter_index")
