"""Readers and sinks on small files."""

import pytest

from versight.sources import io


def test_examples(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿Story_ID,book_name,char,caption,content,label\n1,B,Faria,," He said ""no"",\nand left.",Consistent\n', encoding="utf-8")
    r = io.read_examples(spark, str(p), labelled=True).first()
    assert (r.id, r.character, r.caption, r.content, r.label) == ("1", "Faria", None, 'He said "no",\nand left.', "consistent")
    with pytest.raises(ValueError, match="missing columns"):
        io.resolve(["x"], required=("content",))


def test_books_and_chunks(spark, tmp_path):
    (tmp_path / "My Book.txt").write_text("line one\nline two")
    r = io.read_books(spark, str(tmp_path)).first()
    assert (r.book_name, r.text) == ("My Book", "line one\nline two")
    (tmp_path / "c.jsonl").write_text('{"chunk_id":"a","chunk_text":"t"}\n\n{"chunk_id":"b","text":"u","plot_density_score":2.5}\n')
    assert sorted((r.chunk_id, r.text, r.plot_density_score) for r in io.read_chunks(spark, str(tmp_path / "c.jsonl")).collect()) == [("a", "t", 0.0), ("b", "u", 2.5)]


def test_labels(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text("id,prediction\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="repeated"):
        io.read_labels(spark, str(p))
    assert io.markdown(spark.range(1)) == "| id |\n| --- |\n| 0 |"
