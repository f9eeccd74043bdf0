"""op13 against a trie of dictionaries, on whole tables, generated conversations and edges."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from versight.llm import conversation_trie as ct

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[:2], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    return {c: own.get(c - c % 100, [])[: (h := zlib.crc32(str(c).encode()) % 6)] + v[h:] for c, v in own.items()}


def brute(sequences):
    """All nodes of {conv_id: turns}, by dictionaries of prefixes."""
    members, kids = defaultdict(set), defaultdict(set)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    for p, m in members.items():
        ends = sorted(c for c in m if len(sequences[c]) == len(p))
        yield min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def collected(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(c, t, r, x, 1, "y") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, depth int, h string")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert collected(ct.conversation_trie(df)) == sorted(brute(brute_rebuilt(rows)), key=repr)


@pytest.mark.parametrize("seed,words,partitions", [(1, "ab", 4), (2, "a", 3), (3, "abcdef", 13), (4, "abc", 1), (5, "ab", 40)])
def test_generated(spark, seed, words, partitions):
    """Many shared prefixes, copies, prefixes of others and long chains, over few and many blocks."""
    rng = random.Random(seed)
    seqs = {c: [("u", rng.choice(words) * rng.randint(1, 2)) for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 30]))] for c in range(300)}
    for c in range(300, 360):  # near copies that diverge late
        seqs[c] = seqs[c - 300][: rng.randint(0, 9)] + [("u", rng.choice("xyz"))]
    for c in range(360, 480):
        seqs[c] = seqs[7] + [("u", "tail")]
    digest = lambda t: hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).digest()
    df = spark.createDataFrame([(c, [(bytearray(digest(t)), len(t[1])) for t in s]) for c, s in seqs.items()], "conv_id long, turns array<struct<h: binary, w: long>>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert collected(ct.prefix_trie(df)) == sorted(brute(seqs), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edges(spark):
    rows = [(None, 1, "u", "no id"), (5, None, "u", "first"), (5, 2, None, None), (5, 1, "u", "é🙂"), (100, 1, "u", "a"), (100, 1, "u", "b"), (100, 1, "u", "a"), (101, 1, "x", "c"), (101, 2, "x", "d"), (150, 1, "", ""), (-7, 3, "u", "z" * 100_000), (202, 1, "u", "q")]
    df = table(spark, rows)
    assert collected(ct.conversation_trie(df)) == sorted(brute(brute_rebuilt([r for r in rows])), key=repr)
    assert ct.conversation_trie(df.limit(0)).collect() == []
    one = df.where("conv_id = 202")
    assert collected(ct.conversation_trie(one)) == sorted(brute(brute_rebuilt([rows[-1]])), key=repr)


def test_hot_conversation_and_long_one(spark):
    """A third of all conversations are equal; one has thousands of turns."""
    rows = [(c, t, "u", f"same {t}") for c in range(0, 9000, 9) for t in range(3)] + [(1, t, "u", f"long {t}") for t in range(3000)]
    rows += [(c, t, "u", f"{c % 17} {t}") for c in range(10, 2010, 2) if c % 9 for t in range(2)]
    assert collected(ct.conversation_trie(table(spark, rows))) == sorted(brute(brute_rebuilt(rows)), key=repr)


def test_searches_over_block_minima():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 64, 100):
        minima = rng.integers(-1, 6, n)
        levels = ct._steps_down(minima)
        for b in range(n + 1):
            for v in range(-1, 7):
                below = [i for i in range(n) if minima[i] < v]
                assert ct._next_below(levels, b, v) == next((i for i in below if i >= b), None)
                assert ct._last_below(levels, b, v) == next((i for i in below[::-1] if i < b), None)
            for e in range(b, n + 1):
                assert ct._run_min(levels, b, e) == min([ct._INF, *minima[b:e].tolist()])
