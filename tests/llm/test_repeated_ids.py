"""Near copies are removed by row where ids repeat."""

import corpus_pipeline


def test_near_copies_of_repeated_ids(spark):
    copied = "the harbour froze early that year and merchants waited for the thaw"
    other = "a keeper kept the brass lantern burning through every storm of spring"
    twin = "identical rows of the smallest id must leave exactly one of them here"
    rows = [
        (1, copied), (2, copied), (2, other),  # 2 copies 1 in one text only
        (3, twin), (3, twin), (4, twin), (5, ""), (5, ""), (None, copied), (None, copied), (6, None),
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    want = [(1, copied), (2, other), (3, twin), (5, ""), (5, ""), (None, copied), (None, copied), (6, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
