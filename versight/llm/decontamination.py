"""Benchmark decontamination: BM25 over the test items with block-max pruning, then overlap checks.

The test items are the indexed side; every passage of every training text is a query.
Impacts are divided by the item's score for its own text, so that one threshold in
(0, 1] holds for all items. Passages are windows of ``passage_words`` words that overlap
by half; windows are at least twice as long as the longest item, so each span as long as
an item lies whole in one.

Pruning is that of WAND with block maxima, evaluated for many passages at once:

1. pivot: a passage whose terms' greatest impacts do not add up to the threshold cannot
   reach any item;
2. block maxima: items are ordered by length and cut into blocks; a block whose maxima
   for the passage's terms do not add up to the threshold is skipped;
3. the items of what is left are scored exactly, and *all* at or above the threshold are
   retrieved.

Verification, on words: an item's question and answer must each be covered to
``overlap_percent`` by the item's k-word shingles that the passage has. The answer is what
follows an answer mark; without one, the second half of the words.

Document frequencies, the number of items, their mean length and the longest are taken
over all items by one distributed count. The index is built on the driver and sent to the
tasks in shards of at most ``shard_bytes`` of item text, each with the frequencies of its
own terms, so scores don't depend on the shards. More items take more passes over the
texts; each pass is written before the next shard is sent, and its broadcast is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from versight.llm import textscan
from versight.llm.shared import written

ANSWER_MARK = re.compile(rb"(?:^|\s)(?:answer|a|antwort|r\xc3\xa9ponse|respuesta)\s*:\s+", re.IGNORECASE)
K1, B = 1.2, 0.75


@dataclass
class Index:
    """Terms sorted by hash; postings by term; block maxima by term; items' shingles."""

    terms: np.ndarray
    upper: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    block_max: np.ndarray
    n_items: int
    block: int
    ids: list
    grams: list[np.ndarray]
    question_words: list[int]
    lengths: list[int]
    longest: int


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word window, in order."""
    width = min(k, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.full(n, np.uint64(width))
        for j in range(width):
            h += words[j : n + j] * np.uint64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64))
        return textscan.mix(h)


def _words(raw: bytes) -> np.ndarray:
    return next(textscan.word_hashes([raw], lower=True))[1][0]


@dataclass
class Statistics:
    """Of all items with words: their number, words and longest; and a table (term, df)."""

    items: int
    words: int
    longest: int
    terms: DataFrame | None = None

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        """df of the given terms, sorted by hash."""
        wanted = self.terms.sparkSession.createDataFrame(pa.table({"term": terms.view(np.int64)}))
        found = self.terms.join(wanted, "term").toArrow()
        key = found["term"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        if not np.array_equal(key[order], terms):
            raise ValueError("a term of the items has no frequency")
        return found["df"].to_numpy()[order]


def statistics(rows: DataFrame) -> Statistics:
    """Of the distinct items (k, t)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text.encode("utf-8", "surrogatepass"))
                if len(words):
                    terms = np.unique(words).view(np.int64)
                    # the length goes with the first term, so that it is counted once
                    n = np.zeros(len(terms), np.int64)
                    n[0] = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n)], names=["term", "n"])

    terms = written(rows.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("n") > 0).alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")), "item-terms")
    total = terms.agg(F.sum("items"), F.sum("words"), F.max("longest")).first()
    return Statistics(total[0] or 0, total[1] or 0, total[2] or 0, terms.select("term", "df"))


def build_index(rows: list[tuple[object, str]], k: int, block: int, whole: Statistics | None = None) -> Index:
    """The index of (item id, text) rows; texts without words are left out.

    ``whole`` has the statistics of all items, where ``rows`` are a shard.
    """
    made = []
    for key, text in rows:
        raw = text.encode("utf-8", "surrogatepass")
        words = _words(raw)
        if not len(words):
            continue
        mark = None
        for mark in ANSWER_MARK.finditer(raw):
            pass
        asked = len(_words(raw[: mark.start()])) if mark and 0 < mark.start() and raw[mark.end() :].strip() else (len(words) + 1) // 2
        made.append((len(words), str(key), key, words, asked))
    made.sort(key=lambda x: x[:2])
    lengths = np.array([x[0] for x in made], float)
    term_of, inverse = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[3] for x in made)]), return_inverse=True)
    owner = np.repeat(np.arange(len(made)), lengths.astype(int))
    pair, tf = np.unique(inverse * max(1, len(made)) + owner, return_counts=True)
    term, item = pair // max(1, len(made)), pair % max(1, len(made))
    if whole is None:
        whole = Statistics(len(made), int(lengths.sum()), int(lengths.max()) if made else 0)
    df = whole.frequencies(term_of) if whole.terms is not None and made else np.bincount(term, minlength=len(term_of))
    idf = np.log(1 + (whole.items - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(1.0, whole.words / max(1, whole.items))))
    own = np.bincount(item, impact, minlength=len(made))
    impact = impact / own[item]
    n_blocks = -(-len(made) // block) or 1
    cell, where = np.unique(term * n_blocks + item // block, return_inverse=True)
    most = np.zeros(len(cell))
    np.maximum.at(most, where, impact)
    upper = np.zeros(len(term_of))
    np.maximum.at(upper, term, impact)
    edges = lambda t: np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(term_of)))]).astype(np.int64)
    return Index(term_of, upper, edges(term), item, impact, edges(cell // n_blocks), cell % n_blocks, most, len(made), block, [x[2] for x in made], [_grams(x[3], k) for x in made], [x[4] for x in made], [x[0] for x in made], whole.longest)


def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into a term's run of postings, for each of ``terms``; and which of them they belong to."""
    size = starts[terms + 1] - starts[terms]
    which = np.repeat(np.arange(len(terms)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + starts[terms][which], which


def retrieve(index: Index, term_at: np.ndarray, passage_at: np.ndarray, n_passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item, score) with score >= threshold, given the term of each word and its passage."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    slack = threshold - 1e-9
    size = len(index.terms)
    # pivot, first with repeated words counted again, then without
    rough = np.bincount(passage_at, index.upper[term_at], minlength=n_passages)[passage_at] >= slack
    pair = np.unique(passage_at[rough] * size + term_at[rough])
    passage, term = pair // max(1, size), pair % max(1, size)
    ok = np.bincount(passage, index.upper[term], minlength=n_passages)[passage] >= slack
    passage, term = passage[ok], term[ok]
    if not len(passage):
        return none
    # block maxima
    n_blocks = -(-index.n_items // index.block)
    at, which = _expand(index.block_starts, term)
    alive, row = np.unique(passage, return_inverse=True)
    bound = np.bincount(row[which] * n_blocks + index.blocks[at], index.block_max[at], minlength=len(alive) * n_blocks).reshape(-1, n_blocks) >= slack
    hit = bound.any(1)[row]
    row, term = row[hit], term[hit]
    # exact scores of the items in the blocks left
    at, which = _expand(index.starts, term)
    item, r = index.items[at], row[which]
    kept = bound[r, item // index.block]
    cell, back = np.unique(r[kept] * index.n_items + item[kept], return_inverse=True)
    score = np.bincount(back, index.impacts[at][kept], minlength=len(cell))
    found = score >= slack
    return alive[cell[found] // index.n_items], cell[found] % index.n_items, score[found]


def _covered(grams: np.ndarray, hit: np.ndarray, n_words: int, asked: int) -> tuple[float, float]:
    """Shares of the question's and of the answer's words that the hit shingles cover."""
    width = n_words - len(grams) + 1
    marks = np.zeros(n_words + 1, np.int64)
    np.add.at(marks, np.flatnonzero(hit), 1)
    np.add.at(marks, np.flatnonzero(hit) + width, -1)
    inside = np.cumsum(marks)[:n_words] > 0
    return float(inside[:asked].mean()) if asked else 1.0, float(inside[asked:].mean()) if asked < n_words else 1.0


def find_leaks(index: Index, texts: list[str | None], k: int, threshold: float, overlap: float, passage_words: int, group_words: int = 1 << 16):
    """(row, item index, score, question overlap, answer overlap, passages) of each verified pair."""
    window = max(passage_words, 2 * index.longest)
    step = max(1, window // 2)
    for first, group in textscan.word_hashes([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], lower=True):
        at = 0
        while at < len(group):
            end, total = at, 0
            while end < len(group) and (end == at or total + len(group[end]) <= group_words):
                total += len(group[end])
                end += 1
            words = np.concatenate(group[at:end])
            lengths = np.array([len(x) for x in group[at:end]])
            begin = np.cumsum(lengths) - lengths
            n_windows = np.maximum(1, -(-(lengths - step) // step))
            base = np.cumsum(n_windows) - n_windows
            doc = np.repeat(np.arange(len(lengths)), lengths)
            place = np.searchsorted(index.terms, words)
            known = np.flatnonzero(index.terms[np.minimum(place, len(index.terms) - 1)] == words)
            doc, offset = doc[known], known - begin[doc[known]]
            # each word is in the windows that start at its own step and at the one before
            last = np.minimum(offset // step, n_windows[doc] - 1)
            second = offset // step - 1
            two = (second >= 0) & (second < last)
            passage = np.concatenate([base[doc] + last, base[doc[two]] + second[two]])
            term = np.concatenate([place[known], place[known[two]]])
            p, item, score = retrieve(index, term, passage, int(n_windows.sum()), threshold)
            best: dict[tuple[int, int], list] = {}
            owner = np.repeat(np.arange(len(lengths)), n_windows)
            for x, i, s in zip(p.tolist(), item.tolist(), score.tolist(), strict=True):
                d = int(owner[x])
                lo = (x - int(base[d])) * step
                grams = index.grams[i]
                own = group[at + d][lo : lo + window]
                n_words = index.lengths[i]
                width = n_words - len(grams) + 1
                if len(own) < width:
                    continue
                asked, answered = _covered(grams, np.isin(grams, _grams(own, width)), n_words, index.question_words[i])
                if asked >= overlap and answered >= overlap:
                    seen = best.setdefault((d, i), [0.0, 0.0, 0.0, 0])
                    seen[:] = [max(seen[0], s), max(seen[1], asked), max(seen[2], answered), seen[3] + 1]
            for (d, i), (s, q, a, n) in sorted(best.items()):
                yield first + at + d, i, s, q, a, n
            at = end


def indexes(items: DataFrame, id_col: str, text_col: str, k: int, block: int, shard_bytes: int) -> Iterator[tuple[Index, bool]]:
    """Indexes of about ``shard_bytes`` of item text at most, and whether there are several."""
    rows = items.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(-(-total // shard_bytes)) or 1
    whole = statistics(rows) if n > 1 else None
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == i) if n > 1 else rows
        yield build_index([(r[0], r[1]) for r in part.toLocalIterator()], k, block, whole), n > 1


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.5, overlap_percent: int = 80, passage_words: int = 128, block: int = 8, shard_bytes: int = 32 << 20) -> DataFrame:
    """One row for each pair of a training row and a test item it holds.

    Columns: the two ids, score (the best passage's, rounded to 6), question_overlap,
    answer_overlap (rounded to 4), n_passages. Null and empty texts and items match
    nothing; null ids are carried; repeated rows give repeated rows, repeated items one
    each; empty tables give an empty result. Items of fewer than k words match as a
    whole. Only the named columns are read.
    """
    id_type, item_type = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for built, several in indexes(items, item_id_col, item_text_col, k, block, shard_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not index.value.n_items:
                    continue
                found = list(find_leaks(index.value, b.column(1).to_pylist(), k, threshold, overlap_percent / 100 - 1e-9, passage_words))
                if found:
                    row, item, *values = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array([index.value.ids[i] for i in item], _arrow(item_type)), *(pa.array(np.round(v, 6 if j == 0 else 4)) for j, v in enumerate(values[:3])), pa.array(values[3], pa.int64())],
                        names=["_id", "_item", "score", "question_overlap", "answer_overlap", "n_passages"],
                    )

        part = rows.mapInArrow(scan, f"_id {id_type.simpleString()}, _item {item_type.simpleString()}, score double, question_overlap double, answer_overlap double, n_passages long")
        if several:
            part = written(part, "leaks")
            index.unpersist()
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_id_col})


def without_leaks(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 5, threshold: float = 0.5, overlap_percent: int = 80, passage_words: int = 128, block: int = 8, shard_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; no shuffle."""
    out = docs
    for built, several in indexes(items, item_id_col, item_text_col, k, block, shard_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                if index.value.n_items:
                    texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                    keep[[x[0] for x in find_leaks(index.value, texts, k, threshold, overlap_percent / 100 - 1e-9, passage_words)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(scan, docs.schema)
        if several:
            out = written(out, "unleaked")
            index.unpersist()
    return out


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
