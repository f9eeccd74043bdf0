"""Cross-tokenizer alignment: which tokens of two tokenizers overlap, and how well pairs agree over a corpus.

Every text is encoded by two tokenizers whose tokens spell the same bytes. An occurrence of
a token of A and one of B are linked if their byte ranges overlap. The count of a pair of
ids is the number of documents that hold it linked; a link is best if no pair with its A id
has a higher count. Each document gets sums over its links, as a postings cogroup:

1. Tasks encode blocks of documents and write, for each A id of a block, its postings: the
   B ids linked to it, in how many documents of the block, in which ones and how often.
2. Counts are summed by pair of ids (map side first). How much is posted under an A id, at most one
   number for each entry of the vocabulary, gives it one slice or, if it is hot, several;
   its blocks are dealt over them.
3. Postings are shuffled by A id and slice, with the counts of the A id's pairs ahead of them,
   and sorted there by Spark, which spills. A task reads its rows as a stream: the counts of an A id,
   from which the maximum is taken, then its postings, from which the documents' shares
   come. It holds the counts of one A id, at most one for each entry of B's vocabulary, and
   a bounded number of sums that are emitted when they are full.
4. Shares are summed by document and joined to what step 1 wrote about it.

Token bytes overlap between two neighbouring cuts of either tokenizer, so links are the
cuts of both and groups the cuts that they share.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from versight.llm.shared import written

#: Bounds of a block of documents that a task encodes at a time, and of the postings in a row.
BLOCK_DOCS, BLOCK_BYTES, ROW_POSTINGS = 4096, 1 << 21, 512
#: Postings of a slice, about 20 MB shuffled.
SLICE_POSTINGS = 1 << 22
#: Documents whose sums a task holds before it emits them.
HELD_SUMS = 1 << 20

#: What step 1 writes: rows of documents, and rows of postings (a is not null).
_DOCUMENT = "doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTINGS = "block long, a int, b array<int>, n array<int>, docs array<int>, times array<int>"


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable symbol of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Texts in these code points, without a run of this many letters or blanks, are split alike by both libraries (see the tests).
_PLAIN = re.compile("[^\u0000-\u024f\u2000-\u206f]|\\S{400}|\\s{400}")
#: The pattern of byte-level tokenizers (fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def byte_level(path: str):
    """(encode texts to ids, bytes of each id) of a byte-level .json tokenizer; special strings in texts are plain text.

    Where merges are ranked by the ids of what they make, tiktoken gives the same ids several times as
    fast; it takes the plain texts, ``tokenizers`` all others.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    at, known = byte_of_symbol(), json.loads(tokenizer.to_str())
    added = {x["id"]: x["content"].encode() for x in known["added_tokens"]}
    table = [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        table[i] = added[i] if i in added else bytes(at[c] for c in piece)
    made = [tokenizer.token_to_id("".join(m)) for m in known["model"]["merges"]]
    usual = known["normalizer"] is None and known["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and None not in made and made == sorted(set(made)) and known["model"]["type"] == "BPE"
    fast = tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks={x: i for i, x in enumerate(table) if i not in added}, special_tokens={}) if usual else None

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        for i, text in enumerate(texts):
            plain = fast is not None and not _PLAIN.search(text)
            ids = fast.encode_ordinary(f" {text}") if plain else tokenizer.encode_batch_fast([f" {text}"], add_special_tokens=False)[0].ids
            out[i] = np.array(ids, np.int32)
        return out

    return encode, table


@lru_cache(maxsize=2)
def pieces(path: str):
    """The same of a sentencepiece model, which puts the blank before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    return (lambda texts: [np.array(model.encode(t), np.int32) for t in texts]), table


@lru_cache(maxsize=2)
def _told(n: int) -> list[str]:
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


def _spells(ids: np.ndarray, table: list[bytes], whole: bytes) -> bool:
    return b"".join([table[i] for i in ids.tolist()]) == whole


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values.astype(np.int32)))


class Block:
    """Links and groups of some texts that both tokenizers spell: arrays over all of them.

    Token ends are byte offsets in the concatenation of the texts, so a cut of both
    sides never joins two texts: each ends where both have a cut.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], a_table: list[bytes], b_table: list[bytes]):
        size_a, size_b = (np.array([len(x) for x in t], np.int64) for t in (a_table, b_table))
        self.n_a, self.n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        self.a, self.b = (np.concatenate([np.empty(0, np.int32), *side]) for side in (a, b))
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        self.shared = end_a[end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a] if len(end_b) else end_b
        cuts = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        cuts = cuts[np.diff(cuts, prepend=-1) > 0]
        of = np.cumsum(self.n_a) - 1
        self.text_ends = end_a[of] if len(end_a) else np.empty(0, np.int64)
        self.link_a, self.link_b = self.a[np.searchsorted(end_a, cuts)], self.b[np.searchsorted(end_b, cuts)]
        self.link_text = np.searchsorted(self.text_ends, cuts)
        self.end_a, self.end_b = end_a, end_b
        count = lambda x: np.diff(np.searchsorted(x, self.text_ends, side="right"), prepend=0)
        self.n_links, self.n_groups = count(cuts), count(self.shared)

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        group = np.concatenate([np.searchsorted(self.shared, self.end_a), np.searchsorted(self.shared, self.end_b)])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.argsort(2 * group + side, kind="stable")
        group, side, ids = group[order], side[order], np.concatenate([self.a, self.b])[order]
        # what follows: another token of the side, the other side, the next group
        mark = np.append(np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(int)), 2)
        told = _told(1 << max(8, int(ids.max(initial=0)).bit_length()))
        parts = [told[i] for i in (ids * 3 + mark).tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]

    def postings(self, n_b: int):
        """(pair code, text, times) of each pair of ids and text, sorted."""
        texts = max(1, len(self.n_a))
        key = np.sort((self.link_a.astype(np.int64) * n_b + self.link_b) * texts + self.link_text)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        return key[new] // texts, key[new] % texts, np.diff(np.append(new, len(key)))


def _align_block(keys: np.ndarray, ids: pa.Array, texts: list[str | None], encoders, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of the documents of a block, then those of its postings."""
    (encode_a, table_a), (encode_b, table_b) = encoders
    some = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = (encode([texts[i] for i in some]) if some else [] for encode in (encode_a, encode_b))
    kept = [j for j, i in enumerate(some) if _spells(ids_a[j], table_a, whole := f" {texts[i]}".encode()) and _spells(ids_b[j], table_b, whole)]
    at = np.array([some[j] for j in kept], np.int64)
    block = Block([ids_a[j] for j in kept], [ids_b[j] for j in kept], table_a, table_b)
    own = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    for k, v in own.items():
        v[at] = getattr(block, k)
    shas = [""] * len(texts)
    for i, told in zip(at.tolist(), block.groups(), strict=True):
        shas[i] = hashlib.sha256(told.encode()).hexdigest()
    row = lambda n, found: pa.RecordBatch.from_arrays([found[f.name] if f.name in found else pa.nulls(n, f.type) for f in schema], schema=schema)
    yield row(len(texts), {k: pa.array(v) for k, v in own.items()} | {"id": ids.cast(schema.field("id").type), "doc": pa.array(keys), "groups_sha256": pa.array(shas, pa.string())})
    if not kept:
        return
    code, text, times = block.postings(len(table_b))
    a, places = code // len(table_b), np.arange(len(code))
    # a row ends where the A id changes, and after ROW_POSTINGS
    begin = np.flatnonzero(np.diff(a, prepend=-1))
    rows = places[(places - np.repeat(begin, np.diff(np.append(begin, len(code))))) % ROW_POSTINGS == 0]
    is_row = np.zeros(len(code), bool)
    is_row[rows] = True
    pair = np.flatnonzero(is_row | (np.diff(code, prepend=-1) != 0))
    ends = np.append(rows[1:], len(code))
    pair_ends = np.searchsorted(pair, ends)
    made = {"b": _lists(code[pair] % len(table_b), pair_ends), "n": _lists(np.diff(np.append(pair, len(code))), pair_ends), "docs": _lists(keys[at[text]] - keys[0], ends), "times": _lists(times, ends)}
    yield row(len(rows), made | {"block": pa.array(np.full(len(rows), keys[0])), "a": pa.array(a[rows].astype(np.int32))})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array, list[str | None]]]:
    """(keys, ids, texts) within the bounds of a block; keys follow each other."""
    for batch in batches:
        keys, sizes, begin, total = batch.column(0).to_numpy(), pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), 0, 0
        for i, size in enumerate([*sizes, 0]):
            if i > begin and (i == len(sizes) or i - begin == BLOCK_DOCS or total + size > BLOCK_BYTES):
                yield keys[begin:i], batch.column(1).slice(begin, i - begin), batch.column(2).slice(begin, i - begin).to_pylist()
                begin, total = i, 0
            total += size


def _shares(n_b: int):
    """Reads (a, slice) streams, counts ahead of postings; yields (block, docs, best, total), arrays over documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        filled = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for some in batched(held.items(), 64):
                found = [np.flatnonzero(sums[1]) for _, sums in some]
                ends = np.cumsum([len(i) for i in found])
                columns = [pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(np.concatenate(x))) for x in ([i.astype(np.int32) for i in found], *([sums[k][i] for (_, sums), i in zip(some, found, strict=True)] for k in (0, 1)))]
                yield pa.RecordBatch.from_arrays([pa.array([block for block, _ in some], pa.int64()), *columns], names=["block", "docs", "best", "total"])
            held.clear()

        codes, counts, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        for batch in batches:
            a, block = batch.column("a").to_numpy().astype(np.int64), batch.column("block").to_numpy(zero_copy_only=False)
            flat = {k: batch.column(k).flatten().to_numpy().astype(np.int64) for k in ("b", "n", "docs", "times", "count")}
            width = {k: np.diff(batch.column(k).offsets.to_numpy()).astype(np.int64) for k in ("b", "docs")}
            head = block < 0
            of_pair = np.repeat(np.arange(batch.num_rows), width["b"])
            code, is_head = a[of_pair] * n_b + flat["b"], head[of_pair]
            # the counts of this batch's A ids, and those of the one that a batch before began
            own = np.unique(code[is_head], return_index=True)
            if len(own[0]):
                last = codes // n_b == codes[-1] // n_b if len(codes) else np.empty(0, bool)
                fresh = ~np.isin(own[0], codes[last])
                merged = np.concatenate([codes[last], own[0][fresh]])
                number = np.concatenate([counts[last], flat["count"][own[1]][fresh]])
                order = np.argsort(merged)
                codes, counts = merged[order], number[order]
                first = np.flatnonzero(np.concatenate([[True], codes[1:] // n_b != codes[:-1] // n_b]))
                best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(codes))))
            if not len(flat["docs"]):
                continue
            at = np.searchsorted(codes, code[~is_head])
            of = np.repeat(at, flat["n"])
            share, won = flat["times"] * counts[of], flat["times"] * best[of]
            whose = np.repeat(block, width["docs"])
            order = np.argsort(whose, kind="stable")
            blocks, begin = np.unique(whose[order], return_index=True)
            for key, i, j in zip(blocks.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
                part = order[i:j]
                docs = flat["docs"][part]
                size = int(docs.max()) + 1
                sums = held.get(key)
                if sums is None or sums.shape[1] < size:
                    grown = np.zeros((2, max(size, 64 if sums is None else 2 * sums.shape[1])), np.int64)
                    filled += grown.shape[1] - (0 if sums is None else sums.shape[1])
                    if sums is not None:
                        grown[:, : sums.shape[1]] = sums
                    held[key] = sums = grown
                np.add.at(sums[0], docs, won[part])
                np.add.at(sums[1], docs, share[part])
            if filled > HELD_SUMS:
                yield from emit()
                filled = 0
        yield from emit()

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads shares sorted by block; yields the sums (doc, best, total) of each of its documents."""
    now, sums = None, None

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None:
            i = np.flatnonzero(sums[1])
            yield pa.RecordBatch.from_arrays([pa.array(now + i), pa.array(sums[0][i]), pa.array(sums[1][i])], names=["doc", "best", "total"])

    for batch in batches:
        blocks, docs, best, total = (batch.column(c) for c in range(4))
        for row, block in enumerate(blocks.to_pylist()):
            if block != now:
                yield from done()
                now, sums = block, np.zeros((2, BLOCK_DOCS), np.int64)
            at = docs[row].values.to_numpy()
            sums[0][at] += best[row].values.to_numpy()
            sums[1][at] += total[row].values.to_numpy()
    yield from done()


def align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_postings: int = SLICE_POSTINGS) -> DataFrame:
    """The id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    ``a_path`` is a byte-level .json tokenizer that gets a blank and the text, ``b_path`` a
    sentencepiece model that adds the blank. Texts that are null or empty, or that either
    side spells in other bytes (a normalising model), have no tokens: zeros and ''. A null
    id is carried. Repeated rows are documents of their own and count as such. An empty table
    gives an empty result. Only the two named columns are read, so others may have any names.
    A text is encoded whole, by one call a side.
    """
    n_b = len(pieces(b_path)[1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = byte_level(a_path), pieces(b_path)
        for keys, ids, texts in _blocks(batches):
            yield from _align_block(keys, ids, texts, encoders, schema)

    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parsed = StructType.fromDDL(f"id {docs.schema[id_col].dataType.simpleString()}, {_DOCUMENT}, {_POSTINGS}")
    schema = to_arrow_schema(parsed)
    parts = written(numbered.mapInArrow(encode, parsed), "alignment")
    posted = parts.where("a is not null").select("a", "block", "b", "n", "docs", "times")

    pairs = posted.select("a", F.explode(F.arrays_zip("b", "n")).alias("x")).groupBy("a", "x.b").agg(F.sum("x.n").alias("count"))
    heads = written(pairs.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "count"))).alias("x"), F.sum("count").alias("posted")), "counts")
    slices = F.ceil(F.col("posted") / slice_postings).cast("int")
    total = heads.agg(F.sum("posted")).first()[0] or 0
    hot = heads.where(slices > 1).select("a", slices.alias("slices"))  # at most one row for each entry of A's vocabulary
    dealt = posted.join(F.broadcast(hot), "a", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("block"), "slices").cast("int"), F.lit(0))).drop("slices").withColumn("count", F.array().cast("array<long>"))
    none = F.array().cast("array<int>")
    ahead = heads.select("a", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(-1).cast("long").alias("block"), F.col("x.b").alias("b"), none.alias("n"), none.alias("docs"), none.alias("times"), F.col("x.count").alias("count"))
    streams = ahead.unionByName(dealt).repartition(-(-total // slice_postings) + 1, "a", "slice").sortWithinPartitions("a", "slice", "block")
    shares = streams.mapInArrow(_shares(n_b), "block long, docs array<int>, best array<long>, total array<long>")
    sums = shares.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(_summed, "doc long, best long, total long")

    known = parts.where("doc is not null").select("id", "doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    told = (F.coalesce(c, F.lit(0)).alias(name) for c, name in (("best", "n_best"), ("total", "count_sum")))
    return known.join(sums, "doc", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *told, "groups_sha256")
