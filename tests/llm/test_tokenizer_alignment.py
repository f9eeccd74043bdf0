"""op11 against a loop over all links, on whole texts and on edge cases."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from versight.llm import tokenizer_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha) of each (id, text), by byte ranges alone."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    symbols = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    symbols |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in symbols.values())}
    assert decoders.ByteLevel().decode(["Ġa"]) == " a"
    parsed = []
    for key, text in rows:
        if not text:
            parsed.append((key, [], [], [], ""))
            continue
        ids_a, ids_b = one.encode(f" {text}", add_special_tokens=False).ids, two.encode(text)
        bytes_a = [bytes(symbols[c] for c in one.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            parsed.append((key, [], [], [], ""))
            continue

        def spans(parts):
            at = 0
            for x in parts:
                yield at, at + len(x)
                at += len(x)

        sa, sb = list(spans(bytes_a)), list(spans(bytes_b))
        links, j = [], 0
        for i, (b, e) in enumerate(sa):
            while sb[j][1] <= b:
                j += 1
            k = j
            while k < len(sb) and sb[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        told = ";".join(",".join(str(i) for i, (_, e) in zip(ids_a, sa) if lo < e <= hi) + "|" + ",".join(str(i) for i, (_, e) in zip(ids_b, sb) if lo < e <= hi) for lo, hi in zip([0, *ends], ends)) if len(sa) < 400 else None
        parsed.append((key, ids_a, ids_b, links, (len(ends), told)))
    df = Counter(p for x in parsed for p in set(x[3]))
    best = {}
    for (a, _), n in df.items():
        best[a] = max(n, best.get(a, 0))
    for key, ids_a, ids_b, links, more in parsed:
        if not ids_a:
            yield key, 0, 0, 0, 0, 0, 0, ""
        else:
            yield key, len(ids_a), len(ids_b), more[0], len(links), sum(df[p] == best[p[0]] for p in links), sum(df[p] for p in links), more[1] and hashlib.sha256(more[1].encode()).hexdigest()


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def compare(found, expected):
    assert len(found) == len(expected)
    for got, want in zip(sorted(found, key=repr), sorted(expected, key=repr), strict=True):
        assert tuple(got)[:-1] == want[:-1]
        assert want[-1] is None or got[-1] == want[-1]


@pytest.mark.parametrize("slice_postings", [ta.SLICE_POSTINGS, 500])
def test_against_loop(spark, slice_postings):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    found = ta.align(docs, A, B, slice_postings=slice_postings).select("doc_id", *COLUMNS).collect()
    compare(found, list(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])))


TEXTS = [None, "", " ", "\n\n", "a", "naïve café — 日本語 🙂", "<|endoftext|> <s></s>", "a" * 20_000, "the the the the", "the the the the", "\x00\x01", "tab\tand  two", "x" * 3 + " " * 50, "▁ is a blank there", "word " * 3000]


def test_edges(spark):
    rows = list(enumerate(TEXTS)) + [(None, "the cat"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a long, block string")
    found = ta.align(docs, A, B).select("doc_id", *COLUMNS).collect()
    compare(found, list(brute(rows)))
    by_id = {r.doc_id: r for r in found}
    assert by_id[0].groups_sha256 == "" and by_id[13].n_a == 0  # B spells the mark as a blank
    assert ta.align(docs.limit(0), A, B).collect() == []


def test_small_blocks_and_held_sums(spark, monkeypatch):
    """The same result however blocks are cut and sums are emitted."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).union(spark.createDataFrame([(-1, "x y " * 5000, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.coalesce(1)
    rows = docs.select("doc_id", "text").collect()
    keys, texts = list(range(len(rows))), [r.text for r in rows]
    whole = ta.align(docs, A, B).orderBy("doc_id").collect()
    monkeypatch.setattr(ta, "ROW_POSTINGS", 3)
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(f"id long, {ta._DOCUMENT}, {ta._POSTINGS}"))
    made = list(ta._align_block(np.array(keys), pa.array([r.doc_id for r in rows]), texts, (ta.byte_level(A), ta.pieces(B)), schema))
    assert max(len(x) for x in made[1].column("docs").to_pylist()) == 3
    for x in made[1].to_pylist()[:2000]:
        assert sum(x["n"]) == len(x["docs"]) == len(x["times"]) and len(x["b"]) == len(x["n"])
    assert sum(sum(x) for x in made[1].column("times").to_pylist()) == sum(made[0].column("n_links").to_pylist()) == sum(r.n_links for r in whole)


def test_hot_document_words(spark):
    """One word in a third of all rows: its postings are dealt over slices, counts stay whole."""
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same words here")).otherwise(F.concat(F.lit("same "), F.col("id").cast("string"))).alias("text"))
    found = ta.align(docs, A, B, slice_postings=100).select("doc_id", *COLUMNS).collect()
    compare(found, list(brute([(r.doc_id, r.text) for r in docs.collect()])))


def test_plain_texts_are_split_alike():
    """What goes the fast way has the ids of the tokenizers library: every plain code point in contexts, and whole texts."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encode, _ = ta.byte_level(A)
    slow = Tokenizer.from_file(A)
    slow.encode_special_tokens = True
    points = [chr(i) for i in [*range(0x250), *range(0x2000, 0x2070)]]
    texts = [f"a{c}b {c} {c}{c}1{c}'s \n{c}\t {c}" for c in points] + pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    texts += ["<|endoftext|>'ll 日本", "é" * 399, "x" * 2000, " " * 2000, "٣٤ ᠎ x", "🙂" * 500]
    texts = [t for t in texts if t]
    plain = sum(not ta._PLAIN.search(t) for t in texts)
    assert plain > 0.9 * len(texts)
    expected = [e.ids for e in slow.encode_batch([f" {t}" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode(texts)] == expected
