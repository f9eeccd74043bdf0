"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of at most ``chunk_chars`` characters is encoded in one call. A longer one
is cut into overlapping chunks that are encoded with offsets, so that memory is
bounded by the chunk. Two neighbouring encodings are spliced at a *proven* common
boundary. The tokenizer first cuts out special strings and then scans the rest
with a pattern that never looks back, so what follows a pre-token boundary depends
only on the characters after it, and what precedes it only on the characters up to
it and a bounded look ahead. A position p is therefore stable if

* the left encoding, itself known to be right from its start on, has a pre-token
  boundary at p, at least the longest special string before its end (no special
  string or run is then cut by the end), and
* the right encoding has a pre-token boundary at p too.

If the overlap holds no such position (one long run of letters or of blanks), the
overlap is widened: the left chunk is encoded again from its last proven boundary,
with twice the overlap, until a position is found or the text ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a .json file, without truncation or padding (per worker)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def load_offset_tokenizer(path: str):
    """The same tokenizer whose offsets keep blanks, and its longest special string."""
    from tokenizers import Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    added = tokenizer.get_added_tokens_decoder().values()
    return tokenizer, max([1, *(len(x.content) for x in added)])


class _Encoded:
    """One chunk: token starts and pre-token boundaries as positions in the text."""

    def __init__(self, tokenizer, text: str, begin: int, end: int):
        e = tokenizer.encode(text[begin:end], add_special_tokens=False)
        words, starts = e.word_ids, [begin + a for a, _ in e.offsets]
        self.begin, self.end, self.n = begin, end, len(starts)
        self.at = {}  # boundary -> index of the first token after it
        for i, (w, s) in enumerate(zip(words, starts, strict=True)):
            if i == 0 or w is None or w != words[i - 1]:
                self.at.setdefault(s, i)
        self.sorted = sorted(self.at)


def resync_count(text: str, path: str, chunk_chars: int, overlap_chars: int) -> tuple[int, int, int]:
    """(tokens, chunks, widenings) of one text; equals the count of a single call."""
    tokenizer, guard = load_offset_tokenizer(path)
    step = max(1, chunk_chars - overlap_chars)
    spans = [(b, min(len(text), b + chunk_chars)) for b in range(0, max(1, len(text) - overlap_chars), step)]
    left, start, total, widened = _Encoded(tokenizer, text, *spans[0]), 0, 0, 0
    k = 1
    while left.end < len(text):
        while k < len(spans) - 1 and spans[k][1] <= left.end:
            k += 1  # widened past this chunk
        right = _Encoded(tokenizer, text, *spans[k])
        while True:
            low, high = max(right.begin + 1, start + 1), left.end - guard
            i = bisect_left(left.sorted, low)
            p = next((x for x in left.sorted[i:] if x <= high and x in right.at), None)
            if p is not None:
                total += left.at[p] - left.at[start]
                left, start, k = right, p, k + 1
                break
            widened += 1
            end = min(len(text), left.end + max(overlap_chars, left.end - right.begin))
            left = _Encoded(tokenizer, text, start, end)
            if left.end >= right.end:
                break
    return total + left.n - left.at.get(start, 0), len(spans), widened


def count_texts(texts: list[str | None], path: str, chunk_chars: int, overlap_chars: int, batch_chars: int = 1 << 17):
    """(n_tokens, n_chunks, n_widened) of each text; encodes bounded groups at a time."""
    tokenizer = load_tokenizer(path)
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(texts)
    group: list[int] = []
    size = 0

    def flush():
        nonlocal size
        for i, e in zip(group, tokenizer.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
            out[i] = (len(e), 1, 0)
        group.clear()
        size = 0

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > chunk_chars:
            out[i] = resync_count(text, path, chunk_chars, overlap_chars)
            continue
        if group and size + len(text) > batch_chars:
            flush()
        group.append(i)
        size += len(text)
    if group:
        flush()
    return out


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk_chars: int = 1 << 15,
    overlap_chars: int = 1 << 9,
) -> DataFrame:
    """One row per input row: the id, n_bytes, n_tokens, over_limit, n_chunks, n_widened.

    No shuffle: rows stay in their partitions. Null texts count as empty (0 bytes,
    0 tokens, 0 chunks); a null id is carried; repeated rows give repeated rows; an
    empty table gives an empty result. Only the two named columns are read, so
    other columns may have any names.
    """
    if not 0 < overlap_chars < chunk_chars:
        raise ValueError("overlap_chars must be positive and below chunk_chars")
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counts = count_texts(texts, tokenizer_path, chunk_chars, overlap_chars)
            tokens = [c[0] for c in counts]
            size = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array([c[1] for c in counts], pa.int64()), pa.array([c[2] for c in counts], pa.int64())],
                names=["_id", "n_bytes", "n_tokens", "over_limit", "n_chunks", "n_widened"],
            )

    counted = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {id_type.simpleString()}, {SCHEMA}")
    return counted.withColumnRenamed("_id", id_col)
