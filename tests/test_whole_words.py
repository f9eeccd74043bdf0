"""Whole words in plain texts equal the patterns; capitalised phrases of any length take no stack."""

import itertools

from pyspark.sql import functions as F

from versight.functions import text as T
from versight.operators import ingest

TEXTS = [
    "The the THE, the-the_the the", "", " ", "that", "Thiſ iſ thİs and thıs", "breaK the breaK", "thé the", "éthe theé the9 9the the",
    "cell‍cell cell", "naïve the the the", "slipped away, Slipped  away slipped away", "\U0001d400 the", "the\nthe\r\nthe\tthe", None,
]
PHRASES = ["the", "this", "break", "cell", "slipped away", "THAT", "i"]


def test_words_equal_patterns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("plain", T.plain(F.col("text")))
    slow = [F.regexp_count("text", F.lit(r"(?iU)(?<!\w)\Q" + p + r"\E(?!\w)")) for p in PHRASES]
    fast = [T.phrase_count(F.col("text"), p, F.col("plain")) for p in PHRASES]
    either = [T.any_phrase(F.col("text"), list(pair), F.col("plain")) for pair in itertools.combinations(PHRASES, 2)]
    got = rows.select(F.array(*slow), F.array(*fast), F.array(*(T.phrase_count(F.col("text"), p) for p in PHRASES)), F.array(*either)).collect()
    for text, (want, words, patterns, some) in zip(TEXTS, got, strict=True):
        assert words == want and patterns == want, text
        assert some == [None if text is None else bool(a or b) for a, b in itertools.combinations(want, 2)], text
    assert sum(x for want, *_ in got for x in want if x) > 20


def test_long_runs_of_capitals(spark):
    runs = {"Of The Sea " * 20_000: 1, "Del del deltas Del" + " Del" * 9000 + "ta Dela": 2, "BarB Foo BarB Foo de": 2, "Foo\n the  BAR Xy.": 2}
    rows = spark.createDataFrame(list(runs.items()), "text string, n int")
    f = ingest.density_features(F.col("text"), ("the",), {"a": ("and",)}, ("then",))
    assert [r.got for r in rows.select(f["capitalized_phrase_count"].alias("got")).collect()] == list(runs.values())
