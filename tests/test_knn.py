"""The nearest-neighbour join against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from clipatlas.operators import blocks, knn
from clipatlas.operators.knn import knn_join

SCHEMA = "video_id string, timestamp_start string, title string, note string, embedding array<double>"


def make_rows(rng, n=900, dims=6):
    """A third of the rows are copies of one vector; some are zero, scaled, missing or odd."""
    rows = []
    for i in range(n):
        v = [float(x) for x in rng.normal(size=dims)]
        if i % 3 == 0:
            v = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]
        elif i % 31 == 0:
            v = [0.0] * dims
        elif i % 37 == 0:
            v = [2.0, 4.0, 6.0, 0.0, 0.0, 0.0]
        elif i % 41 == 0:
            v = []
        elif i % 43 == 0:
            v = None
        elif i % 47 == 0:
            v = v[:-1]
        video = None if i % 53 == 0 else f"v{i % 7}"
        rows.append((video, f"0{i % 5}:00", f"t{i:05}", f"note {i}", v))
    return rows


def brute(rows, queries, k, metric):
    found = {}
    for qid, q in queries:
        scored = []
        for r in rows:
            if r[4] is None or len(r[4]) != len(q):
                continue
            a, b = np.array(r[4]), np.array(q)
            if metric == "cosine":
                size = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                d = 1 - ((a * b).sum() / size if size > 0 else 0.0)
            else:
                d = np.sqrt(((a - b) ** 2).sum())
            scored.append((round(float(d), 9), (r[0] is not None, r[0] or ""), r[1], r[2], r[3]))
        found[qid] = [(s[2], s[3], s[4], s[0]) for s in sorted(scored)[:k]]
    return found


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.timestamp_start, r.title, r.note, round(r.distance, 9)))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = make_rows(rng)
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    queries += [(100, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]), (101, [0.0] * 6)]
    base = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return rows, queries, base, spark.createDataFrame(queries, "query_id int, query_embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("k", [1, 5, 2000])
def test_matches_brute_force(data, metric, k):
    rows, queries, base, vectors = data
    got = listed(knn_join(base, vectors, k, metric))
    want = brute(rows, queries, k, metric)
    assert set(got) == set(want)
    for q in want:
        assert got[q] == want[q], q


def test_small_blocks_give_the_same(data, monkeypatch):
    rows, queries, base, vectors = data
    want = brute(rows, queries, 5, "cosine")
    # Queries in many blocks and rows in many chunks, which a shuffle brings together.
    monkeypatch.setattr(knn, "ROW_CHUNK_BYTES", 8000)
    several = knn_join(base, vectors, 5, block_bytes=12_000)
    assert listed(several) == want
    plan = several._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "MapInArrow" not in plan
    # Rows, scores and pairs in small pieces within a task.
    for name, value in (("ROW_BLOCK_BYTES", 480), ("_SCORE_BLOCK", 64), ("_PAIR_BLOCK_BYTES", 200)):
        monkeypatch.setattr(blocks, name, value)
    assert listed(knn_join(base, vectors, 5)) == want


@pytest.mark.parametrize("block_bytes", [12_000, 1 << 26])
def test_bounds_from_some_rows_lose_nothing(data, monkeypatch, block_bytes):
    rows, queries, base, vectors = data
    monkeypatch.setattr(knn, "BOUND_FROM_CORES", 0)
    monkeypatch.setattr(knn, "BOUND_ROWS", 200)
    for metric in ("cosine", "euclidean"):
        assert listed(knn_join(base, vectors, 5, metric, block_bytes=block_bytes)) == brute(rows, queries, 5, metric)


def test_one_scan_for_sixteen_blocks(spark, data, tmp_path):
    rows, queries, base, vectors = data
    base.write.parquet(f"{tmp_path}/base")
    size = len(queries) * (6 * 8 + 5 * knn._COLUMN_BYTES * 4)
    stored = spark.read.parquet(f"{tmp_path}/base")
    found = knn_join(stored, vectors, 5, block_bytes=size // 8 + 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # One scan of the rows and one of the stored queries, and no files read by the tasks themselves.
    assert plan.count("FileScan") == 2 and plan.count("FlatMapCoGroupsInArrow") == 1 and "MapInArrow" not in plan
    assert listed(found) == brute(rows, queries, 5, "cosine")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_rank_does_not_depend_on_the_partitions(spark, parts):
    """Closeness that differs by less than 1e-16, which the distance rounds to the same number."""
    eps = 2.0**-53
    vectors = [("a", [1e-3, 1.0]), ("b", [1e-3 + eps * 1e-4, 1.0]), ("c", [1e-3 + eps * 3e-4, 1.0]), ("d", [1e-3 - eps * 2e-4, 1.0])]
    rows = [("v", "0", name, "", v) for name, v in vectors] + [("v", "0", f"x{i}", "", [-1.0, i / 9]) for i in range(20)]
    base = spark.createDataFrame(rows, SCHEMA).repartition(parts, "title")
    query = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_embedding array<double>")
    exact = {r[2]: r[4][0] / np.sqrt((np.array(r[4]) ** 2).sum()) for r in rows}
    want = sorted(exact, key=lambda t: (-exact[t], t))[:3]
    assert [r.title for r in knn.nearest(base, [1.0, 0.0], 3).collect()] == want
    assert [r.title for r in knn_join(base, query, 3).orderBy("rank").collect()] == want


def test_key_brings_the_same_rows(data):
    rows, queries, base, vectors = data
    assert listed(knn_join(base, vectors, 5, key=["title"])) == brute(rows, queries, 5, "cosine")


def test_a_task_emits_at_most_k_rows_per_query(data):
    _, queries, base, vectors = data
    ids, points = zip(*queries)
    block = blocks.QueryBlock(pa.array(ids, pa.int32()), np.array(points))
    scored = knn._score(base, block, 5, "cosine", "embedding", list(knn.SCENE_ORDER), vectors.schema["query_id"], None)
    assert scored.count() <= 5 * len(queries) * base.rdd.getNumPartitions()


def test_no_queries_and_no_rows(data, spark):
    _, _, base, vectors = data
    none = knn_join(base, vectors.limit(0), 5)
    assert none.count() == 0
    assert knn_join(base.limit(0), vectors, 5).count() == 0
    assert none.columns == knn_join(base, vectors, 5).columns


def test_bad_queries_are_refused(data, spark):
    _, _, base, vectors = data
    with pytest.raises(ValueError, match="unique"):
        knn_join(base, vectors.union(vectors), 5)
    short = spark.createDataFrame([(7, [1.0])], vectors.schema)
    with pytest.raises(ValueError, match="length"):
        knn_join(base, vectors.union(short), 5)
    with pytest.raises(ValueError, match="metric"):
        knn_join(base, vectors, 5, "dot")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_close_neighbours_far_from_the_origin(spark, metric):
    """Differences far below the single precision of the preselection still decide the ranks."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=20) * 1e5
    rows = [("v", "0", f"t{i:04}", "", [float(x) for x in centre + rng.normal(size=20) * 1e-2]) for i in range(600)]
    queries = [(i, [float(x) for x in centre + rng.normal(size=20) * 1e-2]) for i in range(5)]
    got = knn_join(
        spark.createDataFrame(rows, SCHEMA).repartition(3),
        spark.createDataFrame(queries, "query_id int, query_embedding array<double>"), 4, metric,
    )
    titles = {}
    for r in got.orderBy("query_id", "rank").collect():
        titles.setdefault(r.query_id, []).append(r.title)
    for qid, q in queries:
        m = np.array([r[4] for r in rows], dtype=np.longdouble)
        b = np.array(q, dtype=np.longdouble)
        if metric == "euclidean":
            want = np.argsort(((m - b) ** 2).sum(axis=1))[:4]
            assert titles[qid] == [rows[i][2] for i in want]
        else:
            close = (m * b).sum(axis=1) / np.sqrt((m * m).sum(axis=1) * (b * b).sum())
            place = {rows[i][2]: c for i, c in enumerate(close)}
            best = np.sort(close)[::-1][:4]
            assert all(abs(place[t] - c) < 1e-15 for t, c in zip(titles[qid], best))
