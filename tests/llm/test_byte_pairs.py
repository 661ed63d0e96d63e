"""Byte-level BPE against the tiktoken library, and round trips."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clipatlas.llm import byte_pairs, vocabulary

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(open(PATH, "rb").read()), special_tokens={})


def check(spark, encoding, rows, schema="doc_id long, text string"):
    sent = vocabulary.send(spark, PATH)
    encoded = byte_pairs.encode(spark.createDataFrame(rows, schema), sent, public_tokenizers.PATTERN)
    got = byte_pairs.decode(encoded, sent).collect()
    expected = [(r[0], encoding.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got), key=key) == sorted(expected, key=key)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in got)


def test_given_documents(spark, encoding):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(spark, encoding, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_edges(spark, encoding):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, "word  \n\n tab\t!!! 123 l'été don't 日本語 🙂🙂   x"), (5, "many words in a row " * 60_000), (6, "y" * 20_000), (7, "<|endoftext|>")]
    check(spark, encoding, [(*r, 1, "b", 2) for r in rows], "doc_id long, text string, block int, word string, n_tokens int")


def test_small_blocks(spark, encoding, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_CHARS", 50)
    monkeypatch.setattr(byte_pairs, "_ROWS", 3)
    monkeypatch.setattr(byte_pairs, "_IDS_AT_A_TIME", 7)
    check(spark, encoding, [(i, f"text {i % 7} and some more words, number {i} " * (i % 5)) for i in range(60)])


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=200), min_size=1, max_size=60))
def test_any_text(spark, encoding, texts):
    check(spark, encoding, list(enumerate(texts)))


def test_empty_and_unknown(spark):
    sent = vocabulary.send(spark, PATH)
    assert byte_pairs.encode(spark.createDataFrame([], "doc_id long, text string"), sent, public_tokenizers.PATTERN).count() == 0
    null = spark.createDataFrame([(1, None, "old")], "doc_id long, ids binary, decoded string")
    assert byte_pairs.decode(null, sent).first()["decoded"] is None
    bad = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes()))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="token table"):
        byte_pairs.decode(bad, sent).collect()
