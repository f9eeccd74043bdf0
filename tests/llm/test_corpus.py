"""Near copies, leaks, bundles, main text and the pipeline against brute force."""

import base64
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from versight.llm import block_labeller, components, decontamination, html_blocks, ngram_jaccard, warc_bundles

SF = "/root/testdata/sf0.001"


def shingle_sets(rows, k=5):
    out = {}
    for key, text in rows:
        w = [] if text is None else text.encode().lower().split()
        out[key] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_components(rows, percent=80):
    sets = shingle_sets(rows)
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and find(a) != find(b) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in keys}


def near_rows(seed=5, n=90):
    rng = random.Random(seed)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4, 5, 8])):
            w[rng.randrange(len(w))] = f"x{i}_{rng.random()}"
        rows.append((i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n "), (1003, "a b"), (1004, "A  b"), (1005, "a b c"), (1006, rows[3][1])]


def test_near_duplicates_with_large_lists(spark):
    rows = near_rows()
    df = spark.createDataFrame([(None, "a b"), *rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicates(df, full_list=8).collect()}
    assert got.pop(None) == (1, 1003)
    assert got == brute_components(rows)
    assert ngram_jaccard.near_duplicates(df.limit(0)).count() == 0


def variants(n, edits, seed, with_base=True):
    """Copies of a text with a few words replaced, dropped or put in."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))] if with_base else []
    for i in range(1, n):
        w = list(base)
        for _ in range(rng.choice(edits)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 1, 1, 2])] = [f"y{rng.randrange(40)}"] * rng.choice([0, 1, 1, 1, 2])
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("edits", "full_list", "with_base"), [((0, 1, 2, 3, 4), 8, True), ((1, 2, 2, 3, 4), 48, False), ((2, 3, 3, 4), 8, False)])
def test_near_duplicates_of_large_groups(spark, edits, full_list, with_base):
    rows = variants(300, edits, full_list, with_base) + [(k + 5000, t + " and so on it goes") for k, t in variants(60, edits, 9)]
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), full_list=full_list)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


@pytest.mark.parametrize("full_list", [8, 48])
def test_pairs_that_one_edit_cannot_link_do_not_meet(spark, monkeypatch, full_list):
    """800 variants by one-word edits: as brute force, and few candidates of the closing join."""
    rng, rows = random.Random(1), []
    for i in range(800):
        w = [f"w{k}" for k in range(100)]
        for _ in range(rng.choice((2, 3, 4))):
            w[rng.randrange(100)] = f"y{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    closing, original = [], ngram_jaccard._apart_pairs
    monkeypatch.setattr(ngram_jaccard, "_apart_pairs", lambda *x: closing.append(original(*x)) or closing[-1])
    monkeypatch.setattr(ngram_jaccard, "discard", lambda *x: None)
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), full_list=full_list)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)
    assert sum(x.count() for x in closing) < 4 * len(rows)


def test_near_duplicates_ignore_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "A b c d e f", 2, "y"), (2, "A b c d e f", 2, "y"), (3, None, 0, None)]
    got = ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long, n string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(5, 5), (None, 3)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 120)}}


def test_leaks_against_brute_force(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, asked = [(r.doc_id, r.text) for r in docs.collect()], shingle_sets([(r.item_id, r.text) for r in items.collect()])
    want = {(d, i) for d, s in shingle_sets(rows).items() for i, q in asked.items() if 100 * len(s & q) >= 80 * len(q)}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == want and want
    whole = sorted(map(repr, decontamination.leaks(docs, items).collect()))
    for shard_bytes in (900, 3000):
        assert sorted(map(repr, decontamination.leaks(docs, items, shard_bytes=shard_bytes).collect())) == whole
    clashing = docs.selectExpr("*", "1 as item_id", "'x' as score", "'y' as _text")
    assert sorted(map(repr, decontamination.leaks(clashing, items).collect())) == whole
    kept = {r.doc_id for r in decontamination.without_leaks(docs, items).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_block_max_pruning_is_exact():
    rng = random.Random(4)
    words = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(4, 20)))) for i in range(40)]
    index = decontamination.build_index(items, 5, 4)
    for _ in range(40):
        own = decontamination._words(" ".join(rng.choices(words, k=30)).encode())
        term = np.searchsorted(index.terms, own)
        term = term[(term < len(index.terms)) & (index.terms[np.minimum(term, len(index.terms) - 1)] == own)]
        p, item, score = decontamination.retrieve(index, term, np.zeros(len(term), np.int64), 1, 0.4)
        full = np.zeros(index.n_items)
        for t in set(term.tolist()):
            at = slice(index.starts[t], index.starts[t + 1])
            full[index.items[at]] += index.impacts[at]
        assert dict(zip(item.tolist(), score.round(9).tolist(), strict=True)) == {i: round(s, 9) for i, s in enumerate(full.tolist()) if s >= 0.4 - 1e-9}


def test_leak_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "What is the capital of far away lands today Answer: it is blue town by the sea"), (2, ""), (3, "What is the capital of far away lands today nobody knows that at all")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is the capital of far away lands today Answer: it is blue town by the sea"), (8, None), (9, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()] == [(None, 7)]
    assert decontamination.leaks(docs, items.limit(0)).count() == 0 and decontamination.leaks(docs.limit(0), items).count() == 0


def test_bundles_round_trip(spark):
    rows = [(1, "u", "a"), (2, "u", "a"), (3, None, None), (4, "x", ""), (None, "y\r\nz", "a"), (5, "z", "é\r\n\r\n" * 400), (2, "u", "a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc_bundles.write_bundles(df, warc_bundles.archive_folder(spark), frame_bytes=300)
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes) for r in warc_bundles.read_bundles(index).collect())
    assert got == [("1", "revisit", "2", 1), ("2", "response", "", 1), ("2", "response", "", 1), ("3", "revisit", "4", 0), ("4", "response", "", 0), ("5", "response", "", 3 * 400 + 3 * 400), ("null", "revisit", "2", 1)]
    one = next(r for r in index.collect() if r.record_id == "5")
    assert warc_bundles.read_record(*one[1:])["payload"].decode() == "é\r\n\r\n" * 400
    assert warc_bundles.write_bundles(df.limit(0), warc_bundles.archive_folder(spark)).count() == 0


def test_blocks():
    html = '<body><nav><ul><li><a href="x">A &amp; b</a></ul></nav><script>var t="</p>";</script><p>one\n two<br>three<p>four<!-- x --></body>'
    assert [(p.step, t) for p, t, _ in html_blocks.blocks_of(html)] == [("li", "A & b"), ("p", "one two three"), ("p", "four")]


def test_deep_pages_take_linear_memory():
    peak = []
    for n in (4000, 16000):
        tracemalloc.start()
        blocks = html_blocks.blocks_of("<div>x" * n + "</span>" * n)
        assert len(block_labeller.vectors(blocks)) == n
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 6 * peak[0] and peak[1] < 64 << 20


def test_bundles_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    both = pages.unionByName(pages.selectExpr("page_id + 100000 as page_id", "url", "case when page_id % 3 = 0 then null when page_id % 3 = 1 then '' else html end as html"))
    got = warc_bundles.read_bundles(warc_bundles.write_bundles(both.selectExpr("*", "1 as _d", "2 as record_id"), warc_bundles.archive_folder(spark), frame_bytes=20_000)).drop("payload").collect()
    rows, last = [(r.page_id, r.html or "") for r in both.collect()], {}
    for key, html in rows:
        last[html] = max(last.get(html, -1), key)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = {str(k): (len(t.encode()), digest(t), "response" if last[t] == k else "revisit", None if last[t] == k else str(last[t])) for k, t in rows}
    assert {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


def test_main_text_of_all_pages(spark):
    """The pages' articles, taken by a plain parser, are what the labeller finds; with columns of clashing names."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in block_labeller.main_text(pages.selectExpr("*", "1 as _id", "'x' as text", "2 as n_chars")).collect()}
    for r in pages.collect():
        inside = re.search(r"<article\b.*?</article>|<main\b.*?</main>", r.html, re.DOTALL)
        if inside and "comment" not in inside[0]:
            assert got[r.page_id] == "\n".join(t for _, t, _ in html_blocks.blocks_of(inside[0])), r.page_id


PAGES = [  # written by hand, in other shapes than the training pages
    ('<html><body><table><tr><td><ul class="menu"><li><a href=a>Home</a><li><a href=b>Shop</a></ul></td></tr></table><div id="content"><h2>Ice on the bay</h2><p>The harbour froze early in the year, and the ships waited for weeks.</p><p>Nobody had seen this before.</p></div><div id="footer">All rights reserved.</div></body></html>', "Ice on the bay\nThe harbour froze early in the year, and the ships waited for weeks.\nNobody had seen this before."),
    ('<body class="home"><div class="cookie-notice"><p>We use cookies to improve this site.</p></div><article class="post"><h1>A keeper&#39;s log</h1><p>The lantern burned through every storm of that spring.</p></article><section class="comments"><p>Nice post!</p></section><aside><p>Subscribe to our list.</p></aside></body>', "A keeper's log\nThe lantern burned through every storm of that spring."),
]


@pytest.mark.parametrize(("html", "want"), PAGES)
def test_main_text_of_other_pages(html, want):
    blocks = html_blocks.blocks_of(html)
    scores = block_labeller.trained().scores([block_labeller.vectors(blocks)])[0]
    assert "\n".join(t for (_, t, _), z in zip(blocks, scores, strict=True) if z > 0) == want


def test_labeller_held_out_accuracy_and_pages(spark):
    model = block_labeller.trained()
    pages, labels = block_labeller.training_rows(80, 1234)
    hits = np.concatenate([(s > 0) == (y > 0) for s, y in zip(model.scores(pages), labels, strict=True)])
    assert hits.mean() > 0.98
    df = spark.createDataFrame([(1, "u", None), (None, None, ""), (2, "v", "<nav>menu here</nav><article><h1>Head line</h1><p>It is a long story about the sea, he said.</p><p>And it goes on and on.</article><footer>&copy; x</footer>")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in block_labeller.main_text(df).collect()}
    text = "Head line\nIt is a long story about the sea, he said.\nAnd it goes on and on."
    assert got == {1: ("", 0), None: ("", 0), 2: (text, len(text))}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.collect()}
        if name == "ngram_jaccard":
            assert kept == {k for k, (n, c) in brute_components(rows).items() if not n or c == k}
        if name == "personal_data":
            assert kept == {k for k, _ in rows}
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
