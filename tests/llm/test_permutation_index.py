"""op12 against brute force: recall on whole tables, exact answers on small ones, edges and ties."""

import math

import numpy as np
import pytest

from versight.llm import permutation_index as pi


def brute(rows, every=100, k=10):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    for q, v in rows:
        if q % every == 0:
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in rows if i != q)
            yield from ((q, n + 1, i, d) for n, (d, i) in enumerate(near[:k]))


def pairs(found):
    return {(r[0], r[2]) for r in found}


def test_small_table_is_exact(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(250)
    found, expected = pi.search(df).collect(), list(brute([(r.vec_id, r.embedding) for r in df.collect()]))
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted(x[:3] for x in expected)
    assert all(a == pytest.approx(b, rel=1e-12) for a, b in zip((r.score for r in sorted(found)), (x[3] for x in sorted(expected)), strict=True))


def test_recall_on_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    found, expected = pi.search(df.repartition(3)).collect(), list(brute(rows))
    assert len(found) == len(expected)
    assert len(pairs(found) & pairs(expected)) >= 0.9 * len(expected)
    at = {i: np.array(v, float) for i, v in rows}
    for q, rank, i, score in found:
        assert q != i and score == pytest.approx(float(np.linalg.norm(at[q] - at[i])), rel=1e-12)
    by_query = {}
    for q, rank, i, score in found:
        by_query.setdefault(q, []).append((rank, score, i))
    for answers in by_query.values():
        answers.sort()
        assert [r for r, _, _ in answers] == list(range(1, 11)) and [x[1:] for x in answers] == sorted(x[1:] for x in answers)


def test_blocks_of_queries(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert sorted(pi.search(df, every=5, block=20).collect()) == sorted(pi.search(df, every=5).collect())


def test_edges_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, []), (100, [0.5, 0.5]), (200, [-inf, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id string")
    found = sorted(tuple(r) for r in pi.search(df).collect())
    expected = sorted(brute([x for x in rows if x[0] != 9]))
    assert [x[:3] for x in found] == [x[:3] for x in expected]
    assert [x[2] for x in found if x[0] == 0] == [1, 3, 100, 2]
    assert pi.search(df.limit(0)).collect() == [] and pi.search(df.where("vec_id = 5")).collect() == []
    assert pi.search(df.where("vec_id = 0")).collect() == []


def test_many_copies_keep_the_smallest_ids(spark):
    """Copies beyond the reranked share: all have one permutation, so ids decide."""
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 6000, 2)] + [(i, rng.normal(size=3).tolist()) for i in range(1, 3000, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    found = [r for r in pi.search(df, every=3000).collect() if r.query_id == 3000]
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == list(range(0, 20, 2))


def test_footrule(spark):
    """What the lists save is the footrule distance, counted over pivots."""
    rng = np.random.default_rng(2)
    pivots, vectors, query = rng.normal(size=(12, 4)), rng.normal(size=(30, 4)), rng.normal(size=(1, 4))
    order, own = pi.permutations(vectors, pivots, 5), pi.permutations(query, pivots, 5)[0]
    got = pi.saved(own, *pi.inverted(order, 12), 30)
    place = lambda o, p: list(o).index(p) if p in o else 5
    for i in range(30):
        footrule = sum(abs(place(own, p) - place(order[i], p)) for p in range(12))
        assert footrule == 2 * sum(5 - j for j in range(5)) - 2 * got[i]
