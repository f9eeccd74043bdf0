"""Which of many words are substrings of a text: one pass over the text by an automaton, whatever their number.

Words are taken in blocks of bounded size, which are sent to the tasks; each task builds the
block's automaton once. A text's result is a bitmap of the block's words, or its counts with
all queries of the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words of a block, about; a bitmap has an eighth of it in bytes.
BLOCK_WORDS = 1 << 16


class Automaton:
    """Finds which words occur in a text; built in the task that uses it."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.n, self.own = len(words), ahocorasick.Automaton()
        for i, w in enumerate(words):
            self.own.add_word(w, i)
        if words:
            self.own.make_automaton()

    def found(self, text: str | None) -> np.ndarray:
        """Numbers of the words that are part of the text, in order."""
        if not text or not self.n:
            return np.empty(0, np.int64)
        return np.unique(np.fromiter((i for _, i in self.own.iter(text)), np.int64))


def blocks(queries: DataFrame, words: str = "words", size: int = BLOCK_WORDS) -> Iterator[DataFrame]:
    """Parts of ``queries`` (rows with arrays of words) that hold about ``size`` words each."""
    total = queries.agg(F.sum(F.greatest(F.size(words), F.lit(0)))).first()[0] or 0
    n = -(-total // size)
    for i in range(max(1, n)):
        yield queries if n <= 1 else queries.where(F.pmod(F.xxhash64(words), F.lit(n)) == i)


def vocabulary(queries: DataFrame, words: str = "words") -> list[str]:
    """The distinct words of a block, in order."""
    return sorted(r[0] for r in queries.select(F.explode(words).alias("w")).where("w != ''").distinct().collect())


def word_bitmaps(texts: DataFrame, known: list[str], *, key: str, text_col: str = "low") -> DataFrame:
    """(key, found): a bitmap of the words of ``known`` that are part of the text, 64 a long. A null text holds none."""
    shared, kind = texts.sparkSession.sparkContext.broadcast(known), texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, longs = Automaton(shared.value), -(-len(shared.value) // 64) or 1
        for batch in batches:
            bits = np.zeros((batch.num_rows, longs * 64), np.uint8)
            for row, text in enumerate(batch.column(1)):
                bits[row, automaton.found(text.as_py())] = 1
            packed = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * longs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(packed.ravel()))], names=[key, "found"])

    return texts.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, found array<long>")


def bit(bitmap: Column, number: Column) -> Column:
    """Whether the bit of a number from 0 on is set."""
    return F.call_function("getbit", F.get(bitmap, F.floor(number / 64).cast("int")), F.pmod(number, F.lit(64)).cast("int")) == 1


def numbered_words(queries: DataFrame, known: list[str], words: str = "words", out: str = "numbers") -> DataFrame:
    """Adds the numbers in ``known`` of a query's words, repeats kept, empty words left out."""
    shared = queries.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(known)})

    @F.udf("array<int>", useArrow=True)
    def numbers(ws):
        return None if ws is None else [shared.value[w] for w in ws if w in shared.value]

    return queries.withColumn(out, numbers(words))


def overlaps(texts: DataFrame, queries: DataFrame, *, text_key: str, query_key: str, text_col: str = "low", words: str = "words", size: int = BLOCK_WORDS) -> DataFrame:
    """(query_key, text_key, n_hits) of every query with every text: how many of its words, repeats counted, are part of it.

    The output has a row for each pair, as asked; a text is read once for each block of queries.
    """
    spark, out = texts.sparkSession, None
    kinds = [queries.schema[query_key].dataType.simpleString(), texts.schema[text_key].dataType.simpleString()]
    for part in blocks(queries, words, size):
        known = vocabulary(part, words)
        rows = numbered_words(part, known, words).select(query_key, "numbers").toArrow().combine_chunks()
        numbers = [x or [] for x in rows["numbers"].to_pylist()]
        # the queries of each word, one after another
        word = np.array([w for x in numbers for w in x], np.int64)
        query = np.repeat(np.arange(len(numbers)), [len(x) for x in numbers])
        order = np.argsort(word, kind="stable")
        shared = spark.sparkContext.broadcast((known, rows[query_key].combine_chunks(), query[order], np.searchsorted(word[order], np.arange(len(known) + 1))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, keys, query, ends = shared.value
            automaton, sent = Automaton(known), max(1, (1 << 18) // max(1, len(keys)))
            for whole in batches:
                for at in range(0, whole.num_rows, sent):
                    batch = whole.slice(at, sent)
                    hits = np.zeros((batch.num_rows, len(keys)), np.int64)
                    for row, text in enumerate(batch.column(1)):
                        found = automaton.found(text.as_py())
                        size = ends[found + 1] - ends[found]
                        places = np.repeat(ends[found] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(found) else found
                        hits[row] = np.bincount(query[places], minlength=len(keys))
                    of_text = pa.array(np.repeat(np.arange(batch.num_rows), len(keys)))
                    of_query = pa.array(np.tile(np.arange(len(keys)), batch.num_rows))
                    yield pa.RecordBatch.from_arrays([keys.take(of_query), batch.column(0).take(of_text), pa.array(hits.ravel())], names=[query_key, text_key, "n_hits"])

        met = texts.select(text_key, text_col).mapInArrow(run, f"`{query_key}` {kinds[0]}, `{text_key}` {kinds[1]}, n_hits long")
        out = met if out is None else out.unionAll(met)
    return out
