"""Hard negatives and the top-k search against brute force, with edges."""

import math

import numpy as np
import pytest

from clipatlas.llm import hard_negatives, max_score, vector_cells

SCHEMA = "vec_id long, label int, embedding array<double>, score string, v int, query_id string, _shard int"


def usable(vector, scale):
    return vector is not None and all(x is not None and math.isfinite(x * scale) for x in vector)


def whole(vector, scale):
    return [math.floor(scale * x) for x in vector]


def product(a, b):
    return max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=True))))


def by_score(pair):
    return -pair[1], pair[0] is None, pair[0] or 0


def brute_top(rows, asked, k, scale):
    taken = [(i, whole(v, scale)) for i, _, v in rows if usable(v, scale)]
    queries = {}
    for i, _, v in asked:
        if i is not None and usable(v, scale):
            queries[i] = min(queries.get(i, whole(v, scale)), whole(v, scale))
    found = []
    for q, v in queries.items():
        scores = [(i, product(v, w)) for i, w in taken if i != q and len(w) == len(v)]
        found += [(q, rank, i, s) for rank, (i, s) in enumerate(sorted(scores, key=by_score)[:k], 1)]
    return found


def brute_negatives(rows, is_anchor, positives, negatives, scale, window=(50, 95)):
    taken = [(i, str(label), whole(v, scale)) for i, label, v in rows if label is not None and usable(v, scale)]
    anchors = {}
    for i, label, v in taken:
        if i is not None and is_anchor(i):
            anchors[i] = min(anchors.get(i, (v, label)), (v, label))
    found = []
    for a, (v, label) in anchors.items():
        scores = [(i, product(v, w), other) for i, other, w in taken if i != a and len(w) == len(v)]
        best = sorted([x[:2] for x in scores if x[2] == label], key=by_score)[:positives]
        for p, s in best:
            near = sorted([x[:2] for x in scores if x[2] != label and window[0] * s <= 100 * x[1] <= window[1] * s], key=by_score)
            found += [(a, p, rank, n, s, t) for rank, (n, t) in enumerate(near[:negatives], 1)]
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, "y", 2) for i, label, v in rows], SCHEMA)


def mined(spark, rows, folder, is_anchor, condition, positives, negatives, scale):
    vectors = hard_negatives.store_vectors(frame(spark, rows), str(folder), scale)
    got = hard_negatives.mine_hard_negatives(spark, vectors, vectors.where(condition), positives, negatives)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_negatives(rows, is_anchor, positives, negatives, scale)))
    return got


def searched(spark, rows, is_query, condition, k, scale):
    table = frame(spark, rows)
    got = max_score.top_inner_products(spark, table, table.where(condition), k, scale)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    asked = [r for r in rows if r[0] is not None and is_query(r[0])]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_top(rows, asked, k, scale)))
    return got


def clustered(n, dims, seed):
    """Rows around a few centres, with whole groups of copies and few different numbers, so that scores tie."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = np.round(centres[draw.integers(6)] + 0.4 * draw.normal(size=dims), 1)
        rows.append((i, int(draw.integers(4)), v.tolist()))
    return rows + [(n + i, 1, rows[3][2]) for i in range(n // 3)]


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(vector_cells, "ROW_CELL", 700)
    monkeypatch.setattr(vector_cells, "QUERY_CELL", 300)


@pytest.mark.parametrize("dims", [1, 3, 18])
def test_against_brute_force(spark, tmp_path, small_cells, dims):
    rows = clustered(300, dims, dims)
    assert mined(spark, rows, tmp_path, lambda i: i % 10 == 0, "vec_id % 10 = 0", 5, 3, 8).count() > 20
    assert searched(spark, rows, lambda i: i % 10 == 0, "vec_id % 10 = 0", 7, 8).count() > 200


EDGES = [
    (0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (0, 2, [0.5, -2.0]), (5, 1, [1.0, 2.0]), (5, 1, [1.0, 2.0]), (10, None, [1.0, 1.0]), (10, 2, [0.9, 1.1]),
    (15, 1, None), (20, 1, [None, 1.0]), (25, 1, [math.nan, 1.0]), (30, 1, [math.inf, 0.0]), (35, 3, [1.0, 2.0, 3.0]), (40, 3, [1.0, 2.0, 2.0]), (45, 4, [1.0, 2.0, 2.9]),
    (None, 1, [1.0, 2.0]), (None, 2, [0.9, 1.2]), (50, 1, []), (55, 1, []), (60, 2, []), (65, 1, [0.0, 0.0]), (70, 2, [0.0, 0.0]), (75, 1, [-1.0, -2.0]), (80, 2, [-0.7, -1.0]),
    (85, 9, [1e300, 1.0]), (90, 9, [1e300, 2.0]), (95, 8, [3e12, 4.0]), (100, 8, [3e12, 3.0]), (105, 7, [2e12, 1.0]), (110, 1, [1.7e308, 0.0]),
]


def test_edges(spark, tmp_path):
    mined(spark, EDGES, tmp_path, lambda i: i % 5 == 0, "vec_id % 5 = 0", 5, 3, 256)
    searched(spark, EDGES, lambda i: i % 5 == 0, "vec_id % 5 = 0", 4, 64)
    none = frame(spark, [])
    assert max_score.top_inner_products(spark, none, none).count() == 0
    vectors = hard_negatives.store_vectors(none, f"{tmp_path}/none")
    assert hard_negatives.mine_hard_negatives(spark, vectors, vectors).count() == 0
    table = frame(spark, EDGES)
    assert max_score.top_inner_products(spark, table, none).count() == 0


def test_bounds_hold():
    draw = np.random.default_rng(4)
    for dims in (1, 4, 7, 64):
        a, b = (np.floor(256 * draw.normal(0.3, 1, size=(40, dims))) for _ in range(2))
        scores = a @ b.T
        sides = [hard_negatives._Side(m, hard_negatives.summaries(m)) for m in (a, b)]
        for needed in np.quantile(scores, [0.2, 0.9]):
            open_pairs = hard_negatives._open_pairs(*sides, np.full(40, needed), np.full(40, np.inf))
            assert np.all(open_pairs | (scores < needed))
            below = hard_negatives._open_pairs(*sides, np.full(40, -np.inf), np.full(40, needed))
            assert np.all(below | (scores > needed))
    near = np.floor(256 * (np.repeat(draw.normal(size=(40, 1)), 64, axis=1) + 0.05 * draw.normal(size=(40, 64))))
    side = hard_negatives._Side(near, hard_negatives.summaries(near))
    best = np.sort(near @ near.T, axis=0)[-3]
    pruned = 1 - hard_negatives._open_pairs(side, side, best, np.full(40, np.inf)).mean()
    assert pruned > 0.8


def test_terms_are_skipped():
    draw = np.random.default_rng(2)
    vectors = np.floor(64 * draw.normal(size=(500, 16)) * np.geomspace(1, 0.01, 16))
    shard = max_score.Shard(list(range(500)), vectors)
    probed = []
    shard.postings = shard.postings.view(type("Seen", (np.ndarray,), {"__getitem__": lambda self, at: (probed.append(at), np.ndarray.__getitem__(self, at).view(np.ndarray))[1]}))
    places, scores = shard.search(vectors[7], 7, 5)
    want = sorted(((i, s) for i, s in enumerate(vectors @ vectors[7]) if i != 7), key=by_score)[:5]
    assert list(zip(places.tolist(), scores.tolist(), strict=True)) == want
    traversed = [at for at in probed if isinstance(at, np.ndarray)]
    assert len(traversed) == 1 and len(traversed[0]) < 16
