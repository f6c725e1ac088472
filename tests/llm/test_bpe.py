"""BPE (7) against the tokenizers library."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.public_vocabulary())
CODEC = bpe.codec(None)


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.encode(text) == ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "'s", "'LL", "don't", "é", "ß", "日本", "12345", "a1b2", "!!!", "<|endoftext|>", "<|endof", " ", " ", "\u0085", "é", "🙂", "x" * 90, "ab" * 60, " the", "\x1c", "Ⅷ", "²"]), max_size=30).map("".join))
def test_awkward_pieces(text):
    same(text)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_cuts_are_never_crossed():
    assert CODEC.cuts(b"a") == [b"a"]
    for word in (" thereé", "x\ny", "a_b"):
        parts = CODEC.cuts(word.encode())
        assert b"".join(parts) == word.encode()
        assert sum((CODEC.merge(p) for p in parts), ()) == CODEC.merge(word.encode())


def test_odd_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "x", 5), (3, "word " * 100_000, 5), (3, "word", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.digests(docs).collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 1, 1, 100_001]
    out = bpe.tokenized(docs)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "round_trip"] and out.where("not round_trip").count() == 0
    assert bpe.digests(docs.limit(0)).collect() == []
