"""The lexicon as a table against patterns, phrase by phrase."""

import random
import re

from pyspark.sql import functions as F

from versight import lexicons as L
from versight.functions import text as T
from versight.operators import lexicon


def patterns(spark, texts, phrases):
    """{(key, phrase): n} by one pattern a phrase."""
    df = spark.createDataFrame(texts, "id int, text string")
    out = {}
    for p in phrases:
        out |= {(r.id, p): r.n for r in df.select("id", T.phrase_count(F.col("text"), p).alias("n")).collect() if r.n}
    return out


def counted(spark, texts, phrases):
    df = spark.createDataFrame(texts, "id int, text string")
    words = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    return {(r.id, r.phrase): r.n for r in lexicon.phrase_counts(df, words, key="id").collect()}


def test_edges_folding_and_overlaps(spark):
    phrases = ["ha ha", "the", "Kai-Koumou", "Tom Ayrton", "'tis", "o'", "straße", "ΣΟΦΟΣ", "istanbul", "kelvin", "a", "a a a", "--", "x_1", "été", "no longer prisoner", "$5", "."]
    texts = [
        "ha ha ha ha ha", "The the THE there other the.", "kai-koumou kai koumou KAI-KOUMOUS xKai-Koumou", "tom ayrton Tom  Ayrton tom\nayrton", "'tis it'tis ''tis 'tisn", "o'clock o' o'o' (o')",
        "STRASSE straße Straße", "σοφος σοφοσ ΣΟΦΟΣ", "İstanbul ISTANBUL ıstanbul", "Kelvin KELVIN", "a a a a a a a", "---- -- a--b", "x_1 x_12 X_1", "ÉTÉ été étés", "no longer prisoner, no longer  prisoner", "$5 US$5 $55 5$5", "... .", "", "\U0001d4b3 the \U0001f642the\U0001f642",
    ]
    texts = [*enumerate(texts), (99, None)]
    assert counted(spark, texts, phrases) == patterns(spark, texts, phrases)
    assert counted(spark, texts, []) == {} and counted(spark, texts, ["", "the"]) == patterns(spark, texts, ["the"])


def test_generated(spark):
    rng = random.Random(4)
    bits = ["a", "b", "ab", "A", " ", " ", "-", "'", "é", "\n", "_", "1"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    phrases = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(60)})
    assert counted(spark, texts, phrases) == patterns(spark, texts, phrases)


def test_ten_thousand_phrases(spark):
    """Words and pairs of words of all texts; the plan has the size that it has for ten."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    pool = sorted({w.lower() for _, t in rows for w in re.findall(r"[A-Za-z]+(?: [A-Za-z]+)?", t)})
    phrases = random.Random(1).sample(pool, 9000) + [f"absent{i}" for i in range(1000)]
    words = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    found = lexicon.phrase_counts(df, words, key="doc_id")
    few = lexicon.phrase_counts(df, words.where("phrase = 'absent1' or phrase = 'the of'"), key="doc_id")
    nodes = lambda x: len(re.findall(r"^[ :|]*(?:[+:]- )?\w", x._jdf.queryExecution().optimizedPlan().treeString(), re.M))
    assert nodes(found) == nodes(few)
    got = {(r.doc_id, r.phrase): r.n for r in found.collect()}
    wanted, expected = set(phrases), {}
    for key, text in rows:
        parts = re.findall(r"\w+|\W", text.lower())
        for k in (1, 3):
            last = {}
            for i in range(len(parts) - k + 1):
                p = "".join(parts[i : i + k])
                if p in wanted and last.get(p, -9) + k <= i:
                    last[p] = i
                    expected[key, p] = expected.get((key, p), 0) + 1
    assert got == expected


def test_annotate(spark):
    kinds = {"character": {"Faria": ("Faria",), "Tom Ayrton": ("Tom Ayrton",)}, "event": {"custody": L.EVENTS["custody"], "captivity": L.EVENTS["captivity"]}}
    df = spark.createDataFrame([(1, "FARIA left prison; tom ayrton, Faria"), (2, "nobody"), (3, None)], "id int, text string")
    got = {r.id: (r.counts, r.mentioned) for r in lexicon.annotate(df, lexicon.table(spark, kinds), key="id").collect()}
    assert got[1] == ({"character": 3, "event": 2}, {"character": ["Faria", "Tom Ayrton"], "event": ["custody", "captivity"]})
    assert got[2] == got[3] == ({}, {})
