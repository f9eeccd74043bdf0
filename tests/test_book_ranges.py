"""Books read by byte ranges against books read whole."""

import random

import pytest

from versight.operators import book_ranges, ingest
from versight.sources import io

START, END = "*** START OF THE PROJECT GUTENBERG EBOOK X ***", "*** END OF THE PROJECT GUTENBERG EBOOK X ***"


def compare(spark, folder, size, overlap, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    books = io.read_books(spark, folder)
    whole = ingest.build_chunks(ingest.chapters(books), size=size, overlap=overlap)
    expected = {r.chunk_id: r.asDict() for r in whole.collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = {r.chunk_id: r.asDict() for r in book_ranges.book_chunks(spark, folder, size=size, overlap=overlap).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got.keys() == expected.keys()
    for k, v in expected.items():
        assert got[k] == v, (k, got[k], v)
    return len(got)


@pytest.mark.parametrize("split", ["64b", "1k", "128m"])
def test_written_books(spark, tmp_path, split):
    books = {
        "plain": "no heading at all\n" + "some words here\n" * 40,
        "marked": f"front matter\n{START}\nCHAPTER I\nTHE FIRST PART\n\nbody one two three\n" + "word " * 50 + f"\nChapter 2: Named\nbody\r\nof two\rlines\n\nCHAPTER III\n{END}\nback matter " + "tail " * 30,
        "empty": "", "blank": " \n\t\n\n", "late": "lost words\nlost too\n\nchapter 1\n\n\n\nNot a title, since it goes on and on with far too many words in it to be one\n\nCHAPTER 2.\n\t\nA Good Title\nCHAPTER 3\nX\nCHAPTER 4 - \nTitle Here\nthe end",
        "a b": "CHAPTER IV. Chapter IV\nSecond Line Title\ntext text text\n" * 5, "only end": f"CHAPTER 1\nabc def\n{END}\nmore words", "accents": "CHAPTER 1\nÉTÉ EN MÉDOC\nune phrase à côté\n" * 3,
    }
    for name, text in books.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    assert compare(spark, str(tmp_path), 7, 2, split) > 30


def test_generated_books(spark, tmp_path):
    rng = random.Random(6)
    for b in range(6):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(["", " ", "\t", "CHAPTER 1", "chapter ix: Name", "Title Words", "lower words here and more of them", "x " * rng.randint(1, 30), "Chapter 3.", "  CHAPTER 7  ", START if rng.random() < 0.1 else "a", END if rng.random() < 0.1 else "b"]))
        (tmp_path / f"b{b}.txt").write_bytes(rng.choice(["\n", "\r\n"]).join(parts).encode())
    for size, overlap, split in ((5, 1, "100b"), (400, 100, "1k")):
        compare(spark, str(tmp_path), size, overlap, split)


def test_many_tasks(spark, tmp_path):
    """One book without a line that is alone in its chapter is read and cut by many tasks, each of a small part."""
    (tmp_path / "big.txt").write_text("CHAPTER 1\n" + "".join(f"line {i} of one long chapter\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        found = book_ranges.lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 15
        chunks = book_ranges.book_chunks(spark, str(tmp_path))
        assert chunks.count() == -(-(120_000 - 400) // 300) + 1
        last = chunks.orderBy("chunk_index_global").collect()[-1]
        assert last.text.endswith("line 19999 of one long chapter") and last.chunk_index_global == last.chunk_index_in_chapter
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
