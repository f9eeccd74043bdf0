"""Line cleaning, URL verdicts, personal data and quotations."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from versight.llm import line_cleaning, personal_data, quotations, url_filter

SF = "/root/testdata/sf0.001"


def compare(got, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.fetchall()))


def test_line_cleaning_oracle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edges = spark.createDataFrame([(None, None), (9001, ""), (9002, " \n\n"), (9003, "a b c " * 50), (9004, "Home | News | About\nThis is a real line of prose with many words. " * 9), (9004, "x"), (9005, "w" * 5000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(edges)
    compare(line_cleaning.clean_lines(both).drop("clean_text"), line_cleaning.oracle(), documents=both.toArrow())


def test_line_cleaning_keeps_good_and_drops_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    bad = line_cleaning.clean_lines(docs).join(labels, "doc_id").where("not base_failed and kept != (quality = 1)")
    assert bad.count() <= 2


def test_keep_clean_equals_clean_lines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.clean_text for r in line_cleaning.clean_lines(docs).where("kept").collect()}
    assert {r.doc_id: r.text for r in line_cleaning.keep_clean(docs).collect()} == want
    assert line_cleaning.keep_clean(docs.limit(0)).count() == 0


def test_url_verdicts_oracle_and_aliases(spark):
    rows = [
        (1, "https://A.net/x#f", '<link rel="canonical" href="https://b.example.com/de/1">'), (2, "https://b.example.com/de/1", ""),
        (3, "http://c.net/", '<META HTTP-EQUIV=refresh content="0;url=https://a.net/x">'), (4, "http://d.net", '<link href="/q" rel=canonical>'),
        (5, "http://d.net/q", None), (6, None, None), (7, "nourl", ""), (8, "http://e.net/a", "<link rel=canonical href=//f.org/es/>"), (8, "http://e.net/a", ""), (None, "http://x.example.org/es/1", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = url_filter.judge_urls(pages)
    verdicts = {r.page_id: (r.verdict, r.reason) for r in got.collect()}
    assert verdicts[1] == verdicts[3] == ("block", "alias") and verdicts[2] == ("block", "rule") and verdicts[8] == ("allow", "alias") and verdicts[None] == ("block", "rule")
    compare(got, url_filter.oracle(), pages=pages.toArrow())
    real = spark.read.parquet(f"{SF}/pages.parquet")
    clashing = pages.selectExpr("*", "'q' as host", "1 as u", "2 as _node")
    assert sorted(map(repr, url_filter.judge_urls(clashing).collect())) == sorted(map(repr, got.collect()))
    compare(url_filter.judge_urls(real), url_filter.oracle(), pages=real.toArrow())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_relative_links(spark):
    """(link, absolute): against https://a.net/x/y.html?q=1, by the rules of URL references."""
    cases = [("z.html", "https://a.net/x/z.html"), ("./z", "https://a.net/x/z"), ("../z", "https://a.net/z"), ("../../../z", "https://a.net/z"), ("?id=3", "https://a.net/x/y.html?id=3"), ("/q/../r/.", "https://a.net/r/"), ("#top", None), ("//b.org", "https://b.org/"), ("HTTP://B.org/a/./b?c=/../d", "http://b.org/a/b?c=/../d"), ("mailto:x@y.z", None), ("..", "https://a.net/")]
    pages = spark.createDataFrame([(i, "https://a.net/x/y.html?q=1", f'<link rel="canonical" href="{t}">') for i, (t, _) in enumerate(cases)], "page_id long, url string, html string")
    for (_, want), row in zip(cases, pages.orderBy("page_id").collect(), strict=True):
        got = [r.v for r in url_filter.alias_edges(spark.createDataFrame([row], pages.schema)).collect()]
        assert got == ([want] if want else [])
    based = spark.createDataFrame([(1, "https://c.net/p", '<BASE href="sub/"><link rel=canonical href=z>'), (2, "https://c.net/p2", "<base href='https://example.org/es/'><meta http-equiv=refresh content='0;url=z'>"), (3, "https://example.org/es/z", None)], pages.schema)
    assert {r.v for r in url_filter.alias_edges(based).collect()} == {"https://c.net/sub/z", "https://example.org/es/z"}
    both = pages.unionByName(based)
    compare(url_filter.judge_urls(both), url_filter.oracle(), pages=both.toArrow())
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(based).collect()} == {1: "allow", 2: "block", 3: "block"}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
            return 16 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_personal_data_base(spark):
    texts = [None, "", "a@b.c_d@e.f x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 é 10.0.0.1", "4012 8888 8888 1881 4012888888881881 4012888888881882", "+1 (555) 123-4567 +1+2 +12345678", "x " * 2000 + "q@r.st " * 600, "1" * 50_000, "a" * 50_000 + "@"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    source = {r.doc_id: r.text for r in docs.collect()}
    for r in personal_data.find_personal_data(docs).collect():
        want = plain_spans(source[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in PLAIN)
        assert set(want) <= set(r.spans.split(",")) or not want


def test_personal_data_bootstraps_and_redacts(spark):
    rows = [(i, f"please contact email q{i}@z.com now thanks") for i in range(12)] + [(100, "contact email foo1234bar now please"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in personal_data.find_personal_data(docs).collect()}
    assert found[100] == "email:14:24" and found[101] == ""
    assert {r.doc_id: r.text for r in personal_data.redact(docs).collect()}[100] == "contact email [EMAIL] now please"
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there my friend\nHow are you today my dear\n\nI am going home now ok"), (1, 1, "assistant", "On Monday Bob wrote:\n> how ARE you  today my dear\nI am fine thank you"),
        (1, 2, "user", ">> how are you today my dear\n> I am fine thank you\nGood to hear that"), (1, 3, "user", "> unknown words here\nfoo"), (2, 0, "user", None), (None, 1, "user", "> I am fine thank you"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.clean_text, r.n_quotes, r.max_level, r.parent_turn, r.root_turn, r.depth) for r in quotations.link_quotations(df).collect()}
    assert got[1, 1] == ("I am fine thank you", 1, 1, 0, 0, 1) and got[1, 2] == ("Good to hear that", 2, 2, 1, 0, 2)
    assert got[1, 3] == ("foo", 1, 1, None, 3, 0) and got[2, 0] == ("", 0, 0, None, 0, 0) and got[None, 1][3] is None
    assert quotations.link_quotations(df.limit(0)).count() == 0


@pytest.mark.parametrize("url,host,path", [("HTTP://A.com/x?q#f", "a.com", "/x"), ("a://b", "b", ""), ("x", "", ""), ("a://b?c://d/e", "b", "")])
def test_hosts(spark, url, host, path):
    r = spark.createDataFrame([(url,)], "u string").select(url_filter.host_of(F.col("u")).alias("h"), url_filter.path_of(F.col("u")).alias("p")).first()
    assert (r.h, r.p) == (host, path)
