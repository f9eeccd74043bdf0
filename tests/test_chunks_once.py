"""Chunks are made once a run, cut by pieces of words, and scored in batches of any size alike."""

import pytest
from pyspark.sql import functions as F

from versight.operators import ingest
from versight.plans import registry

DOCS = {1: "that ship of old sailed north", 2: "with the lantern that burned", 3: " ".join(f"w{i}" for i in range(950))}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("once")
    spark.createDataFrame([(0, "The old ship sailed north with a lantern."), (1, "That lantern burned in the old ship.")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = [(i, t, "en", "web", len(t)) for i, t in DOCS.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return str(at)


def counted(spark, monkeypatch):
    """How many chunks are made, however often a plan is run."""
    made, whole = spark.sparkContext.accumulator(0), registry.annotated

    @F.udf("string")
    def seen(text):
        made.add(1)
        return text

    monkeypatch.setattr(registry, "annotated", lambda *a, **k: whole(*a, **k).withColumn("text", seen("text")))
    return made


@pytest.mark.parametrize("name", ["cst_01_profiles", "ret_21_legacy_retrieve", "cst_03_merged_state", "cst_05_features", "ret_17_hybrid"])
def test_chunks_are_made_once(spark, small, monkeypatch, name):
    made = counted(spark, monkeypatch)
    registry.QUERIES[name](spark, small).collect()
    assert made.value == 5  # two short texts, and three chunks of the long one


@pytest.mark.parametrize(("size", "overlap"), [(400, 100), (7, 3), (6, 4), (5, 0), (1, 0)])
@pytest.mark.parametrize("tail", ["stop", "emit"])
def test_chunks_by_pieces(spark, size, overlap, tail):
    texts = ["", " \n\t ", "one", " a  b\nc ", *(" ".join(f"w{i}" for i in range(n)) for n in (5, 6, 7, 12, 399, 400, 401, 700, 701))]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(ingest.chunk_array(F.col("t"), size, overlap, tail)).collect()]
    for text, chunks in zip(texts, got, strict=True):
        w = text.split()
        starts = range(0, (max(len(w) - overlap - 1, 0) if tail == "stop" else len(w) - 1) + 1, size - overlap) if w else []
        assert chunks == [" ".join(w[s : s + size]) for s in starts]
    assert spark.createDataFrame([(t,) for t in texts], "t string").select(ingest._chunk_count(F.col("t"), 400, 100).alias("n")).agg(F.sum("n")).first()[0] == sum(1 if len(t.split()) <= 400 else -(-(len(t.split()) - 400) // 300) + 1 for t in texts if t.split())


def test_terms_by_plain_text(spark):
    """Terms are found alike with and without the plain text's help."""
    from versight import lexicons as L
    from versight.functions import text as T
    from versight.operators import anchors as A

    terms = [*L.ANCHOR_CHARACTERS, *L.LOCATIONS, *L.ROLES]
    texts = [f"{a}{t}{b}" for t in terms for a, b in (("", ""), ("x ", ", y"), ("x", ""), ("", "s"), ("-", "-"))]
    texts += [t.upper() for t in terms] + [t.replace(" ", "-").lower() for t in terms] + [t.replace(" ", "  and ") for t in terms] + ["", "chie\u017f", "\u212aai-koumou", "first  -mate", "abb\u00c9", "abbe_"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("p", T.plain(F.col("t")))
    for r in rows.select("t", A.find_terms(F.col("t"), terms).alias("a"), A.find_terms(F.col("t"), terms, F.col("p")).alias("b")).collect():
        assert r.a == r.b, r.t
