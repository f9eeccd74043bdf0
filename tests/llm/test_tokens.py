"""Token counts and byte-level BPE against the libraries."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from versight.llm import byte_bpe, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = list(" \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u200b'sStrea09é日😀.,!-<|>") + ["'s", "'ll", "<|endoftext|>", "  ", " \n", "the", "<unk>", "▁", "\u0301"]


def texts(n, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_resynchronised_counts_equal_one_call():
    tokenizer = token_counts.load_tokenizer(JSON)
    rng = random.Random(2)
    for text in texts(300, 200, 1):
        text += rng.choice(["", "a" * 300, " " * 300, "<|endoftext|>" * 5])
        size, overlap = rng.choice([(20, 1), (40, 15), (64, 19)])
        if len(text) > size:
            assert token_counts.resync_count(text, JSON, size, overlap)[0] == len(tokenizer.encode(text, add_special_tokens=False)), (text, size, overlap)


def test_overlap_is_widened():
    assert token_counts.resync_count("a" * 2000 + " b", JSON, 100, 10)[2] > 0


def test_count_tokens_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "hi there", "x"), (3, "hi there", "x"), (3, "hi there", "x"), (4, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, JSON).collect())
    n = len(token_counts.load_tokenizer(JSON).encode("word " * 30_000, add_special_tokens=False))
    assert got == [(0, 8, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, 8, 2, False), (3, 8, 2, False), (4, 150_000, n, True)]
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_equals_reference(reference):
    bpe = byte_bpe.load(RANKS, P.PATTERN)
    sample = texts(2000, 20, 3) + ["x" * 500, "", "a  b \n c"]
    for text, (ids, n, raw) in zip(sample, bpe.run(sample), strict=True):
        want = reference.encode_ordinary(text)
        assert (",".join(ids), n, b"".join(raw)) == (",".join(map(str, want)), len(want), text.encode())
        assert bpe.decode(bpe.encode(text)) == text.encode()


def test_byte_bpe_edges(spark, reference):
    df = spark.createDataFrame([(1, None), (None, "é 日本"), (2, ""), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.encode_documents(df, RANKS, P.PATTERN, outputs=("ids", "decoded", "n_tokens", "decoded_sha256")).collect()}
    assert got[None].ids == reference.encode_ordinary("é 日本") and got[None].decoded == "é 日本"
    assert got[1].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert byte_bpe.encode_documents(df.limit(0), RANKS, P.PATTERN).count() == 0
