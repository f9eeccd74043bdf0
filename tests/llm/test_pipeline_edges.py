"""Every stage on nulls, empty texts, repeated rows, clashing columns and an empty table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LINE = "The harbour froze early that year, and the merchants of the old town waited for many long weeks until the ships could sail again."
ITEM = "Which bay froze first in the long winter of that year? Answer: the northern bay by the old lighthouse."
ROWS = [
    (1, LINE), (1, LINE), (2, LINE.lower()), (None, LINE), (3, None), (None, None), (4, ""), (4, ""), (5, "short"),
    (6, f"{LINE} {ITEM} Nobody could say why it was so, and nobody asked."), (7, f"{LINE} Write to jane.doe@example.org if you want to know more about the thaw."),
]
KEPT = {  # per stage: sorted (doc_id, text) that must be left of ROWS
    "quality_rules": [(None, LINE), (1, LINE), (1, LINE), (2, LINE.lower()), (6, ROWS[9][1]), (7, ROWS[10][1])],
    "ngram_jaccard": [(None, LINE), (None, None), (1, LINE), (3, None), (4, ""), (4, ""), (5, "short"), (6, ROWS[9][1]), (7, ROWS[10][1])],
    "benchmark_decontamination": [r for r in ROWS if r[0] != 6],
    "personal_data": [(i, t and t.replace("jane.doe@example.org", "[EMAIL]")) for i, t in ROWS],
}
CLASHING = ("key", "h", "v", "n", "_id", "_text", "_vi", "_vk", "_vnew", "_line_verdict", "component_id", "n_shingles", "_k", "base", "spans", "item_id", "n_tokens")


def frame(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stage_edges(spark, folder, name, stage):
    out = stage(spark, frame(spark, ROWS), folder)
    if name in KEPT:
        assert tuple(out.columns) == corpus_pipeline.COLUMNS
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(KEPT[name], key=repr)
    else:
        got = out.collect()
        assert sorted((r.doc_id for r in got), key=repr) == sorted((i for i, _ in ROWS), key=repr)
        assert all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4))
    assert stage(spark, frame(spark, ROWS).limit(0), folder).count() == 0
