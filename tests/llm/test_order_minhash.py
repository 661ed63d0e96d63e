"""Order MinHash against the same method spelled out over exploded rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from clipatlas.llm import order_minhash as omh

TEXTS = [
    "", "one", "a b a b a b a b", "a b a b", "the cat sat on the mat and the cat sat on the hat", "x" * 100, "日本語の文 テスト 🙂🙂🙂", "  spaced\tout\n text ", "a b c d e f g h i j",
    " ".join(f"w{i % 37}" for i in range(900)),
]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def brute(spark, texts):
    """text -> {bin: entry}: k-mers numbered in Python, hashed by Spark's function in rows of their own."""
    rows = []
    for n, text in enumerate(texts):
        pieces = ["", *re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text), ""]
        seen = {}
        for p in range(len(pieces) - 1):
            kmer = (pieces[p], pieces[p + 1])
            rows.append((n, p, *kmer, seen.get(kmer, 0)))
            seen[kmer] = seen.get(kmer, 0) + 1
    hashed = spark.createDataFrame(rows, "n int, p int, a string, b string, o int").withColumn("h", F.xxhash64("a", "b", "o")).collect()
    bins = {}
    for r in hashed:
        bins.setdefault((r["n"], (r["h"] >> 58) & 63), []).append(r)
    tuples = []
    for (n, bin_), members in bins.items():
        chosen = sorted(sorted(members, key=lambda r: r["h"])[:2], key=lambda r: r["p"])
        words = [w for r in chosen for w in (r["a"], r["b"])]
        tuples.append((n, bin_, *(words + [None, None])[:4], len(chosen)))
    df = spark.createDataFrame(tuples, "n int, bin int, a string, b string, c string, d string, k int")
    entry = F.when(F.col("k") == 2, F.xxhash64("a", "b", "c", "d")).otherwise(F.xxhash64("a", "b")).bitwiseAND(65535)
    found = {n: {} for n in range(len(texts))}
    for r in df.withColumn("e", entry).collect():
        found[r["n"]][r["bin"]] = r["e"]
    return found


def test_fingerprints(spark):
    df = omh.with_fingerprint(spark.createDataFrame(list(enumerate(TEXTS)), "n int, t string"), "t", "f")
    got = {r["n"]: {x >> 16: x & 65535 for x in r["f"]} for r in df.collect()}
    assert got == brute(spark, TEXTS)


@pytest.mark.parametrize("ranges", [1, 2, 5, 200])
def test_neighbours(spark, ranges):
    rows = [(i * 13 % 101, f"{i} text with {i * i} words and é {'more ' * (i % 9)}") for i in range(60)] + [(-5, "日本語テキスト"), (200, None), (300, "")]
    df = omh.edited_fingerprints(spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, fingerprint string, _n string"), ranges)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    got = {r["doc_id"]: r for r in df.collect()}
    ordered = sorted(((d, t or "") for d, t in rows), reverse=True)
    for (d, text), (next_id, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        r = got.pop(d)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1 and r["fingerprint"] == r["edited_fingerprint"]
        if following == text:
            assert r["near_next"] == 1
    assert not got


def test_likeness_follows_the_order(spark):
    base = [f"w{i}" for i in range(400)]
    other = base[200:] + base[:200]
    texts = [" ".join(base), " ".join(base[:300] + [f"n{i}" for i in range(100)]), " ".join([f"n{i}" for i in range(400)]), " ".join(other), " ".join(base)]
    df = omh.with_fingerprint(spark.createDataFrame([(t, texts[0]) for t in texts], "t string, b string"), "t", "f")
    df = omh.with_fingerprint(df, "b", "g").select(omh.likeness(F.col("f"), F.col("g")).alias("x"))
    same, edited, unlike, moved, again = [r["x"] for r in df.collect()]
    assert same == again == 1 and unlike < 0.05 and 0.3 < edited < 0.9 and moved < 0.9


def test_repeated_rows_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert omh.edited_fingerprints(spark.createDataFrame([], schema), 3).count() == 0
    one = omh.edited_fingerprints(spark.createDataFrame([(1, "only one here")], schema), 3).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"only one only").hexdigest()
    rows = omh.edited_fingerprints(spark.createDataFrame([(1, "same text")] * 3 + [(None, "null id"), (2, "word " * 100_000)], schema), 3).collect()
    assert len(rows) == 5 and sorted(r["near_next"] == 1 for r in rows if r["doc_id"] == 1) == [False, True, True]


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = omh.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count()
    by_text = {}
    for r in docs.join(spark.createDataFrame([(r["doc_id"], r["fingerprint"]) for r in rows], "doc_id long, f string"), "doc_id").collect():
        by_text.setdefault(r["text"], set()).add(r["f"])
    assert all(len(f) == 1 for f in by_text.values())
    mean = lambda c: sum(r[c] for r in rows) / len(rows)
    assert mean("near_edited") > 0.2 > 0.05 > mean("near_next")
