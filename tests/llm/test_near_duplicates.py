"""Near duplicates against all pairs in plain Python."""

import random

import numpy as np
import pytest

from clipatlas.llm import near_duplicates as near
from clipatlas.llm.components import connected_components
from clipatlas.llm.shingles import ShingleReader


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, threshold=75):
    """doc_id -> (number of shingles, component) by comparing all pairs."""
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= threshold * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets if d is not None)


def run(spark, rows, tmp_path, schema="doc_id long, text string"):
    found = near.near_duplicate_groups(spark, spark.createDataFrame(rows, schema), f"{tmp_path}/run")
    got = found.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    return got


def test_given_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = near.near_duplicate_groups(spark, docs, f"{tmp_path}/run").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute([tuple(r) for r in docs.collect()])


def made(seed):
    """Groups whose members drift away from their first: links by way of others, near the threshold."""
    draw = random.Random(seed)
    rows = []
    for g in range(12):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([9, 40, 120]))]
        for _ in range(draw.choice([2, 5, 25])):
            rows.append(" ".join(words))
            words = list(words)
            for _ in range(draw.randrange(1, 3)):
                words[draw.randrange(len(words))] = f"v{draw.randrange(10**6)}"
    rows += [r.upper() for r in rows[:20]] + ["common boilerplate line of seven words " + r for r in rows[::7]]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_drifting_groups(spark, tmp_path, seed):
    rows = made(seed)
    got = run(spark, rows, tmp_path)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_blocks_of_a_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near, "_BLOCK", 3)
    rows = made(5)
    got = run(spark, rows, tmp_path)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_edges(spark, tmp_path):
    long = " ".join(f"t{i % 9000}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two\n"), (6, "two one"), (9, long), (8, long + " end"), (7, "É a b c d"), (10, "é a b c d"), (4, "one two"), (11, "a\x1cb c d e")]
    got = run(spark, [(*r, 1, 2, "k") for r in rows] + [(None, "one two", 1, 2, "k"), (None, "alone here", 1, 2, "k")], tmp_path, "doc_id long, text string, node int, component_id int, key string")
    named = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None)
    assert named == brute(rows)
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None and r["component_id"]) == [(1, 4)]
    assert len(got) == len(rows) + 2


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_shingles_of_long_and_short_texts():
    texts = ["a b c d e f", "", "x", "a b c d e f", " ".join(str(i) for i in range(70_000)), None]
    sets = list(ShingleReader().sets(texts))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[3]).all()
    alone = next(iter(ShingleReader().sets([" ".join(str(i) for i in range(40_000, 40_009))])))
    assert np.isin(alone, sets[4]).all()


def test_estimate():
    draw = np.random.default_rng(1)
    a, b = draw.integers(0, 1 << 64, (2, 4000, near._WORDS), dtype=np.uint64)
    assert abs(near.likeness(near.equal_nibbles(a, b)).mean()) < 0.01
    assert (near.likeness(near.equal_nibbles(a, a)) == 1).all()


def test_estimate_as_expression(spark):
    a, b = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, (2, 50, near._WORDS))
    b[::2, :3] = a[::2, :3]
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)], "a array<long>, b array<long>")
    got = [r["n"] for r in df.select(near._equal_nibbles("a", "b").alias("n")).collect()]
    assert got == near.equal_nibbles(a.view(np.uint64), b.view(np.uint64)).tolist()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components(spark, tmp_path, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    got = dict(connected_components(spark, spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect())
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    assert got == label


def test_no_links(spark, tmp_path):
    assert connected_components(spark, spark.createDataFrame([], "a long, b long"), str(tmp_path)).count() == 0
