"""Byte-level BPE through sentencepiece, with the model serialised from the vocabulary.

A rank file maps byte strings to ranks. Each byte is mapped to a printable
character, so that every token becomes a piece, and the pieces are written as a
sentencepiece ``ModelProto`` of type BPE: piece i has score -i (the lowest rank
merges first, as in byte-level BPE), the normaliser is the identity, and no dummy
prefix, blank removal or blank escaping is done. Texts are cut by the pre-token
pattern, each pre-token is byte-mapped and encoded, and ids (which equal ranks) are
decoded by the inverse mapping.

A pre-token that is itself a token gets that token at once, as byte-level BPE has
it, also where merges alone would not reach it.

Equal pieces of text are encoded once: a text is cut before each single blank that a
non-blank follows. This is a pre-token boundary whatever stands around it (in the
pattern a blank is taken together with what follows, and a run of blanks gives up its
last one), so the results of the parts can be kept in a bounded table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Parts of text kept with their ids, per Python worker.
KEPT_PARTS = 400_000
KEPT_PART_CHARS = 64


def byte_characters() -> list[str]:
    """A printable character for each byte, all different: printable Latin-1 stays, the rest moves up from U+0100."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in stay else next(moved) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float | bool) -> bytes:
    """One protobuf field: bytes, float (fixed 32 bits) or integer."""
    import struct

    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token, blank, rank on each line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids equal the ranks; the id after them is the unknown piece."""
    chars = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    # ModelProto: 1 pieces {1 piece, 2 score, 3 type}, 2 trainer_spec, 3 normalizer_spec
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal)) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    absent = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(24, False) + _field(40, len(tokens)) + b"".join(_field(k, absent) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, False) + _field(4, False) + _field(5, False)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBpe:
    """Encoder and decoder over one serialised model."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        chars = byte_characters()
        self.mapped = {b: ord(c) for b, c in enumerate(chars)}
        bytes_of = {c: b for b, c in enumerate(chars)}
        self.find = regex.compile(pattern).findall
        pieces = self.model.id_to_piece(list(range(len(self.tokens))))
        self.decoded = [bytes(bytes_of[c] for c in piece) for piece in pieces]
        self.text = [str(i) for i in range(len(self.tokens))]
        self.kept: dict[str, tuple[str, int, bytes]] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text; special strings are ordinary text."""
        return [i for ids in self._ids(self.find(text)) for i in ids]

    def _ids(self, pres: list[str]) -> list[list[int]]:
        """Ids of each pre-token, by one call of the model."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pres]
        whole = [self.ranks.get(r) for r in raw]
        missing = [r.decode("latin-1").translate(self.mapped) for r, w in zip(raw, whole, strict=True) if w is None]
        ids = iter(self.model.encode(missing, num_threads=1) if missing else ())
        return [next(ids) if w is None else [w] for w in whole]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids by the inverse mapping of the pieces' characters."""
        return b"".join([self.decoded[i] for i in ids])

    def run(self, texts: list[str | None]) -> list[tuple[tuple[str, ...], int, tuple[bytes, ...]]]:
        """(ids of the parts, joined by commas each; number of ids; decoded bytes of the parts) of each text."""
        cut = [_parts(t) if t else [] for t in texts]
        kept = self.kept
        if len(kept) > KEPT_PARTS:
            kept.clear()
        new = [p for p in set().union(*cut) if p not in kept]
        pres = [self.find(p) for p in new]
        single = list(set().union(*pres))
        text, decoded = self.text, self.decoded
        table = {p: (",".join([text[i] for i in ids]), len(ids), b"".join([decoded[i] for i in ids])) for p, ids in zip(single, self._ids(single), strict=True)}
        for part, own in zip(new, pres, strict=True):
            if len(own) == 1:
                kept[part] = table[own[0]]
            else:
                ids, n, raw = zip(*[table[p] for p in own], strict=True)
                kept[part] = (",".join(ids), sum(n), b"".join(raw))
        out = []
        for parts in cut:
            if parts:
                ids, n, raw = zip(*map(kept.__getitem__, parts), strict=True)
                out.append((ids, sum(n), raw))
            else:
                out.append(((), 0, ()))
        for part in new:
            if len(part) > KEPT_PART_CHARS:
                del kept[part]
        return out


def _parts(text: str) -> list[str]:
    """The text cut before each single blank between other characters, as far as these are not white space."""
    cut = text.split(" ")
    out = [cut[0]]
    for x in cut[1:]:
        if x and not x[0].isspace() and x[0] not in "\x85\u180e\u200b\ufeff":
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out if out[0] else out[1:]


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids_sha256", "decoded_sha256")) -> DataFrame:
    """The id and, of each row's whole text, the named ``outputs``.

    Outputs: ``ids`` (array of int), ``decoded`` (string), ``n_tokens`` (long),
    ``ids_sha256`` (of the decimal ids joined by commas), ``decoded_sha256`` (of the
    decoded bytes). No shuffle. Null texts count as empty; null ids are carried;
    repeated rows give repeated rows; an empty table gives an empty result. Other
    columns are not read, so their names cannot clash.
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    id_type = docs.schema[id_col].dataType.simpleString()

    def values(ids: tuple[str, ...], n: int, decoded: tuple[bytes, ...]) -> dict:
        made: dict = {"n_tokens": n}
        joined, whole = ",".join(ids), b"".join(decoded)
        if "ids" in outputs:
            made["ids"] = [int(x) for x in joined.split(",")] if joined else []
        if "decoded" in outputs:
            made["decoded"] = whole.decode("utf-8", "replace")
        if "ids_sha256" in outputs:
            made["ids_sha256"] = sha256(joined.encode()).hexdigest()
        if "decoded_sha256" in outputs:
            made["decoded_sha256"] = sha256(whole).hexdigest()
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(ranks_path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [values(*x) for x in bpe.run(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kinds[k][1]) for k in outputs)], names=["_id", *outputs])

    schema = ", ".join([f"_id {id_type}", *(f"{k} {kinds[k][0]}" for k in outputs)])
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
