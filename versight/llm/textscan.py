"""Words of many texts at once, as 64-bit hashes, with numpy only.

The bytes of a block of texts are scanned together: each byte is looked up in a table
of random 64-bit values, and the hash of a word is the sum of value times a power of an
odd base, taken from prefix sums (all modulo 2**64) and then mixed. Work and memory are
a few arrays of the block's length, so blocks are kept near ``BLOCK`` bytes; one longer
text is scanned in blocks of its own, cut at white space.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _tables(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]), out=up)
        np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, inverse, np.uint64)]), out=down)
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _scan(raw: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, byte offset of its end) of a block."""
    data = np.frombuffer(raw, np.uint8)
    blank = _SPACES[data]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.empty(0, np.uint64), end
    size = max(BLOCK * 2, 1 << int(len(data)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_tables(lower)[data] * up[: len(data)], out=total[1:])
        h = (total[end] - total[begin]) * down[begin]
        return mix(h + (end - begin).astype(np.uint64)), end


def _pieces(raw: bytes) -> list[bytes]:
    """A long text in blocks that end at white space where there is any."""
    out, at = [], 0
    while len(raw) - at > BLOCK:
        cut = max(raw.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            later = [x for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (x := raw.find(c, at + BLOCK)) >= 0]
            if not later:
                break
            cut = min(later)
        out.append(raw[at:cut])
        at = cut
    out.append(raw[at:])
    return out


def word_hashes(texts: list[bytes], lower: bool = False):
    """For groups of texts of about ``BLOCK`` bytes: (index of the first, [hashes of each text's words])."""
    group: list[bytes] = []
    first, size = 0, 0

    def flush():
        h, end = _scan(b" ".join(group), lower)
        bounds = np.cumsum([len(x) + 1 for x in group])
        return first, np.split(h, np.searchsorted(end, bounds[:-1], side="left"))

    for i, raw in enumerate(texts):
        if len(raw) > BLOCK:
            if group:
                yield flush()
                group = []
            yield i, [np.concatenate([_scan(p, lower)[0] for p in _pieces(raw)])]
            first, size = i + 1, 0
            continue
        if group and size + len(raw) > BLOCK:
            yield flush()
            group, first, size = [], i, 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield flush()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the k-word shingles, sorted; fewer words are one shingle; none give none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(n, k)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, np.uint64(width))
        for j in range(width):
            h += words[j : n - width + 1 + j] * np.uint64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64))
        return np.unique(mix(h))
