"""The flag-containment join and the one-pass search for words, against loops."""

import random

from pyspark.sql import functions as F

from versight.operators import retrieval, substrings, vectors


def made(spark, seed=0, n=300):
    rng = random.Random(seed)
    flags = [f"f{i}" for i in range(90)]
    weight = [1 / (i + 1) for i in range(90)]
    pick = lambda k: rng.choices(flags, weight, k=k)
    claims = [(i, rng.choice(["A", "B", None]), rng.choice([None, []]) if i % 10 == 0 else pick(rng.randint(1, 4)) + (["never"] if i % 17 == 0 else [])) for i in range(60)]
    store = [(i, "A" if i % 3 else "B", pick(rng.randint(0, 40)) if i % 20 else None) for i in range(n)] + [(n, None, flags)]
    return claims, store, spark.createDataFrame(claims, "claim int, book_name string, wanted array<string>"), spark.createDataFrame(store, "id int, book_name string, held array<string>")


def test_flag_join(spark):
    claims, store, a, b = made(spark)
    pairs, asked, rows = vectors.flag_join(a, b)
    got = pairs.join(asked.select("_claim", "claim"), "_claim").join(rows.select("_row", "id"), "_row").select("claim", "id")
    expected = {(c, i) for c, book, wanted in claims for i, other, held in store if wanted is not None and book is not None and book == other and set(wanted) <= set(held or [])}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert vectors.flag_join(a.limit(0), b)[0].collect() == [] and vectors.flag_join(a, b.limit(0))[0].collect() == []


def test_no_pair_beyond_the_rarest_flag(spark, monkeypatch):
    """Without the bitmaps' test the join makes as many rows as the lists of the claims' rarest flags hold."""
    claims, store, a, b = made(spark, 1)
    df = {}
    for _, book, held in store:
        for f in set(held or []):
            df[book, f] = df.get((book, f), 0) + 1
    bound = sum(min(df.get((book, f), 0) for f in set(wanted)) for _, book, wanted in claims if wanted and book)
    monkeypatch.setattr(vectors.F, "forall", lambda *x: F.lit(True))
    assert vectors.flag_join(a.where("size(wanted) > 0"), b)[0].count() == bound


def test_words_in_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(100, None), (101, "")]
    queries = [(i, [word() for _ in range(rng.randint(0, 6))]) for i in range(40)] + [(50, None), (51, [""]), (52, ["ab", "ab"])]
    t, q = spark.createDataFrame(texts, "t int, low string"), spark.createDataFrame(queries, "q int, words array<string>")
    expected = {(b, a): sum(w in (x or "") for w in ws or [] if w) for a, x in texts for b, ws in queries}
    for size in (1 << 16, 20):
        assert {(r.q, r.t): r.n_hits for r in substrings.overlaps(t, q, text_key="t", query_key="q", size=size).collect()} == expected
    known = substrings.vocabulary(q)
    bits = substrings.word_bitmaps(t, known, key="t")
    counted = substrings.numbered_words(q, known).select("q", "numbers").join(bits.select("t", "found"))
    got = counted.select("q", "t", F.size(F.filter("numbers", lambda n: substrings.bit(F.col("found"), n))).alias("n")).where("numbers is not null")
    assert {(r.q, r.t): r.n for r in got.collect()} == {k: v for k, v in expected.items() if k[0] != 50}


def test_match_as_a_whole(spark):
    claims = spark.createDataFrame([("s", 1, "he fled the prison", "B", ["Faria"], ["event_escape"], [1.0, 0.0]), ("s", 2, "no flags wanted here", "B", [], [], None), ("s", 3, "null wants nothing", "B", None, ["event_escape"], None)], "story_id string, claim_id int, claim_text string, book_name string, characters array<string>, event_cols array<string>, embedding array<double>")
    store = spark.createDataFrame([("B", "Faria fled the prison", {"Faria": 1, "event_escape": 1}, [1.0, 0.0]), ("B", "Faria slept", {"Faria": 1, "event_escape": 0}, None), ("C", "Faria fled", {"Faria": 1, "event_escape": 1}, None)], "book_name string, chunk_text string, flags map<string,int>, embedding array<double>")
    got = {r.claim_id: [(x.chunk_text, round(x.score, 6)) for x in r.claim_chunks] for r in vectors.match(claims, store).collect()}
    words = lambda c, t: sum(w in t.lower() for w in c.split() if len(w) > 2)
    assert got[1] == [("Faria fled the prison", 0.75 * words("fled the prison", "Faria fled the prison") + 0.25 + 0.5)]
    assert {t for t, _ in got[2]} == {"Faria fled the prison", "Faria slept"} and 3 not in got
    assert spark.createDataFrame([("he fled the prison", "Faria FLED the prison")], "a string, b string").select(retrieval.keyword_overlap(F.col("a"), F.col("b")).alias("n")).first().n == 3
