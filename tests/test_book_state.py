"""Merged states of books against what all chunks give anew."""

from pyspark.sql import functions as F

from versight.operators import book_state, ingest, timeline
from versight.plans import registry

NAMES = registry.NAMES


def told(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def test_states_equal_a_new_build(spark, tmp_path):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 200").orderBy("doc_id").limit(20).collect()]
    path = f"file://{tmp_path}/s"
    book_state.create(spark, path)

    def same(books):
        everything = full(books)
        assert told(book_state.cooccurrence(spark, path)) == told(timeline.cooccurrence(everything))
        assert told(book_state.profiles(spark, path)) == told(timeline.profiles(everything, NAMES))
        assert told(book_state.frames(spark, path)) == told(timeline.build(everything))

    def full(books):
        rows = [(b, c, texts[(ord(b[0]) * 3 + c) % len(texts)]) for b in books for c in range(1, 4)]
        df = spark.createDataFrame(rows, "book_name string, chapter_index int, text string")
        return ingest.annotate(ingest.build_chunks(df, size=60, overlap=20), NAMES, registry.EVENTS, registry.MARKERS)

    book_state.add(full(["d", "b"]), path, NAMES)
    same(["b", "d"])
    book_state.add(full(["a", "e", "c"]), path, NAMES)
    same(["a", "b", "c", "d", "e"])
    book_state.remove(spark.createDataFrame([("b",), ("e",), ("nothing",)], "book_name string"), path)
    same(["a", "c", "d"])
    book_state.add(full(["b"]), path, NAMES)
    same(["a", "b", "c", "d"])
    assert told(book_state.cooccurrence(spark, path, version=1)) == told(timeline.cooccurrence(full(["b", "d"])))
    assert book_state.read(spark, path, "books").where(F.col("book_name") == "e").count() == 0
    assert book_state.vacuum(spark, path) == []
