"""A chunk that lies in one range of a file is one piece, and lines are divided at the same white space as whole books."""

import pytest
from pyspark.sql import functions as F

from versight.functions import store
from versight.operators import book_ranges, ingest
from versight.sources import io


def _chunks(spark, folder, size, overlap):
    whole = ingest.build_chunks(ingest.chapters(io.read_books(spark, folder)), size=size, overlap=overlap)
    return {r.chunk_id: r.asDict() for r in whole.collect()}


@pytest.mark.parametrize("split", ["300b", "128m"])
def test_pieces_are_chunks(spark, tmp_path, monkeypatch, split):
    body = "".join(f"line {i} of a\x1cbook,\x0bwith  odd\tblanks\x85 in it\n" for i in range(60))
    (tmp_path / "a.txt").write_bytes(f"CHAPTER 1\n{body}\tchapter 2. \nShort Title\n{body}{'long ' * 90}\nchapter of accidents\nCHAPTER 3\n\t\nCHAPTER 4\none two".encode())
    (tmp_path / "b.txt").write_bytes(("word " * 333).encode())
    kept = {}
    monkeypatch.setattr(book_ranges, "written", lambda df, what: kept.setdefault(what, store.written(df, what)))
    expected = _chunks(spark, str(tmp_path), 20, 5)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found = {r.chunk_id: r.asDict() for r in book_ranges.book_chunks(spark, str(tmp_path), size=20, overlap=5).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == expected and len(found) > 90
    pieces = kept["pieces"].where("chunk is not null")
    if split == "128m":  # before, a row a line and chunk; what ends within the overlap is a piece and no chunk
        assert len(found) <= pieces.count() <= len(found) + 5
        assert pieces.where("whole").count() >= len(found) - 2
    else:
        assert pieces.where("not whole").count() > 20


def test_long_lines_are_no_titles(spark):
    rows = spark.createDataFrame([("The Long Road",), ("THE " * 25 + "X",), ("A " * 12,), ("no title here",), ("A" * 100,), ("A" * 101,)], "line string")
    got = [r[0] for r in rows.select(F.coalesce(ingest.titled(F.trim("line")), F.lit(False))).collect()]
    assert got == [True, False, True, False, True, False]
    short = [r[0] for r in rows.select(ingest.titled(F.col("line")).isNull()).collect()]
    assert short == [False, True, False, False, False, True]
