"""Jump consistent hashing against the published loop in plain Python."""

import zlib

import pytest
from pyspark.sql import functions as F

from clipatlas.llm.sharding import jump_state, shard_documents, stable_key


def jump(key, buckets):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < buckets:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


KEYS = [0, 1, 2, 7, 10**6, 2**31, 2**63 - 1, -1, -(2**63), -12345, *range(1000, 1100)]


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 64, 65, 1000])
def test_shards_are_those_of_the_loop(spark, shards):
    df = spark.createDataFrame([(k,) for k in KEYS], "k long").select("k", jump_state(F.col("k"), shards).alias("s"))
    assert {r["k"]: r["s"]["shard"] for r in df.collect()} == {k: jump(k, shards) for k in KEYS}


def test_no_shards_is_an_error():
    with pytest.raises(ValueError):
        jump_state(None, 0)


ROWS = [(i, "text %d" % i) for i in range(300)] + [(5, "text 5")] * 40 + [(6, None), (7, ""), (None, "é" * 10), (None, None), (8, "x" * 300_000)]


def test_documents(spark):
    docs = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, slot string, shard int")
    rows = [r.asDict() for r in shard_documents(docs, 16, slices=7).collect()]
    assert len(rows) == len(ROWS)
    expected = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert expected == sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows)
    for r in rows:
        assert r["shard"] == jump(r["doc_id"] or 0, 16) and r["grown_shard"] == jump(r["doc_id"] or 0, 17) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 16)
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_empty_and_text_keys(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    keyed = spark.createDataFrame([("a",), ("b",), (None,)], "k string").select(jump_state(stable_key("k"), 5)["shard"].alias("s"))
    assert all(0 <= r["s"] < 5 for r in keyed.collect())
