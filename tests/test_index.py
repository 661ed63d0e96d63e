"""Clustered tables: assignment, exact search by bounds of cells, and cells whose rows change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipatlas.operators import centroids, ivf
from clipatlas.operators.knn import knn_join
from clipatlas.operators.search import prompt_search_batch, scene_search
from clipatlas.schemas import PROMPTS, SCENES

SCHEMA = "video_id string, timestamp_start string, title string, embedding array<double>"


def around(centres, n, spread, seed, first=0):
    """Rows near some centres, a third of them one vector, and some zero vectors and gaps."""
    draw = np.random.default_rng(seed)
    rows = []
    for i in range(first, first + n):
        v = centres[draw.integers(len(centres))] + spread * draw.normal(size=centres.shape[1])
        v = centres[0] if i % 3 == 0 else 0 * v if i % 50 == 1 else v
        rows.append((f"v{i % 7}", "00:00", f"t{i:05}", None if i % 50 == 2 else v.tolist()))
    return rows


CENTRES = np.random.default_rng(8).normal(size=(40, 16))
ROWS = around(CENTRES, 3000, 0.1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("rows")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{folder}/rows")
    return spark.read.parquet(f"{folder}/rows")


@pytest.fixture(scope="module")
def table(spark, stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    ivf.ivf_build(stored, path)
    return ivf.ivf_open(spark, path)


def cells_of(spark, path):
    return {r.title: (r.cell, round(r.norm, 9)) for r in ivf.ivf_rows(spark, path).select("title", "cell", "norm").collect()}


def test_rows_go_to_the_nearest_centroid_below_the_nearest_coarse_one(spark, table):
    home = f"{table.path}/{table.about.version}"
    coarse, fine = centroids.load_coarse(spark, home), spark.read.parquet(f"{home}/centroids").orderBy("cell").collect()
    assert len(coarse.centres) < len(fine) <= table.about.n_cells and len({r.cell for r in fine}) == len(fine)
    for r in ivf._rows(table).filter("cell >= 0").limit(300).collect():
        v = np.array(r.embedding) / np.linalg.norm(r.embedding)
        above = int((coarse.centres @ v).argmax())
        near = {f.cell: float(np.dot(f.centre, v)) for f in fine if f.coarse == above}
        assert near[r.cell] >= max(near.values()) - 1e-9 and abs(near[r.cell] - r.toward) < 1e-9
    reach = {r.cell: (r.n_rows, r.toward) for r in ivf.ivf_reach(table).collect()}
    rows = ivf._rows(table).groupBy("cell").agg(F.count("*").alias("n"), F.min("toward").alias("t")).collect()
    assert {r.cell: (r.n, r.t) for r in rows} == reach


def test_many_centroids_are_dealt_with_the_rows(spark, stored, table, tmp_path, monkeypatch):
    """Above the stated size centroids are not sent to all tasks; rows get the same cells."""
    monkeypatch.setattr(ivf, "SENT_CENTROIDS", 0)
    assert ivf.ivf_measured(table) == table.about
    monkeypatch.setattr("clipatlas.operators.knn.ROW_CHUNK_BYTES", 20_000)
    seen = []
    monkeypatch.setattr(centroids, "two_levels", lambda *a: seen.append(a))
    ivf.ivf_build(stored, str(tmp_path))
    assert not seen and cells_of(spark, str(tmp_path)) == cells_of(spark, table.path)


def test_coarse_level_has_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(centroids, "SENT_BYTES", 3 * 8 * 16)
    monkeypatch.setattr(centroids, "COARSE_BYTES", 200 * 8 * 16)
    monkeypatch.setattr(centroids, "FINE_MOST", 5)
    vectors = spark.createDataFrame([(r[3],) for r in ROWS if r[3] and any(r[3])], "vector array<double>").distinct()
    n_cells = centroids.fit(vectors, 16, 50, str(tmp_path), 3)
    assert spark.read.parquet(f"{tmp_path}/coarse").count() <= 3 and n_cells <= 15
    assert spark.read.parquet(f"{tmp_path}/centroids").count() == n_cells


def test_exact_search_opens_few_cells(spark, stored, table):
    draw = np.random.default_rng(5)
    asked = [*(CENTRES[i] + 0.1 * draw.normal(size=16) for i in range(6)), CENTRES[0], np.zeros(16), draw.normal(size=16)]
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(asked)], "query_id int, query_embedding array<double>")
    want = {(r.query_id, r["rank"]): (r.title, r.distance) for r in knn_join(stored, queries, 5).collect()}
    for more in ({}, {"nprobe": 1}):
        got = ivf.ivf_search_batch_exact(spark, table, queries, **more)
        assert {(r.query_id, r["rank"]): (r.title, r.distance) for r in got.collect()} == want
    opened = []
    for i, q in enumerate(asked[:6]):
        close = 1 - want[i, 5][1]
        cells = ivf.ivf_reaching(table, q.tolist(), close).collect()
        opened.append(len(cells))
        inside = {r.cell for r in ivf._rows(table).filter(F.col("title").isin([want[i, r][0] for r in range(1, 6)])).collect()}
        assert inside <= {c.cell for c in cells} | {ivf.NO_CELL}
        assert [c.bound for c in cells] == sorted((c.bound for c in cells), reverse=True)
    assert sum(opened) < 0.25 * 6 * table.about.n_cells


def test_exact_search_for_one_query(spark, sf, tmp_path):
    names = SCENES.fieldNames()
    rows = [tuple(dict(zip(("video_id", "timestamp_start", "title", "embedding"), r)).get(c, "gcs" if c == "source" else "") for c in names) for r in ROWS]
    spark.createDataFrame([r for r in rows if r[names.index("embedding")]], SCENES).write.parquet(f"{tmp_path}/scenes")
    scenes = spark.read.schema(SCENES).parquet(f"{tmp_path}/scenes")
    ivf.ivf_build(scenes, f"{tmp_path}/cells")
    for q in (CENTRES[3], CENTRES[0], np.zeros(16), -CENTRES[5]):
        want = scene_search(scenes, q.tolist()).collect()
        assert ivf.ivf_search_exact(spark, f"{tmp_path}/cells", q.tolist()).collect() == want
        assert ivf.ivf_search_exact(spark, f"{tmp_path}/cells", q.tolist(), nprobe=1).collect() == want


def test_probes_are_measured_again(spark, stored, tmp_path):
    """Rows of another distribution are appended: the probes follow, and the recall of what is there now is kept."""
    path = str(tmp_path / "cells")
    ivf.ivf_build(stored, path)
    other = np.random.default_rng(9).normal(size=(400, 16))
    rows = [("w", "00:00", f"u{i:05}", v.tolist()) for i, v in enumerate(other)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/more")
    more = spark.read.parquet(f"{tmp_path}/more")
    ivf.ivf_append(more, path, "more")
    before = ivf.ivf_open(spark, path).about.nprobe
    assert ivf.ivf_measure(spark, path) == ivf.ivf_open(spark, path).about.nprobe > before
    everything = stored.unionByName(more)
    queries = spark.createDataFrame([(i, (v + 0.05).tolist()) for i, v in enumerate(other[:60])], "query_id int, query_embedding array<double>")
    recall = ivf.ivf_recall(knn_join(everything, queries, 5), ivf.ivf_search_batch(spark, path, queries), ["title"])
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9
    assert ivf.ivf_rows(spark, path).count() == sum(r[3] is not None for r in ROWS) + 400


def test_cells_follow_the_rows(spark, stored, tmp_path):
    """Many rows of another distribution: their cells are split, emptied ones dissolved, and nothing is lost or found twice."""
    path = str(tmp_path / "cells")
    ivf.ivf_build(stored, path, nlist=24)
    far = np.random.default_rng(12).normal(size=(60, 16)) + 3
    more = [(f"w{r[0]}", "00:00", f"x{r[2]}", r[3]) for r in around(far, 4000, 0.05, 13)]
    spark.createDataFrame(more, SCHEMA).write.parquet(f"{tmp_path}/more")
    extra = spark.read.parquet(f"{tmp_path}/more")
    ivf.ivf_append(extra, path, "more")
    uneven = max(r.n_rows for r in ivf.ivf_cells(spark, path).collect() if r.cell >= 0)
    queries = spark.createDataFrame([(i, (v + 0.02).tolist()) for i, v in enumerate(np.concatenate([far[:15], CENTRES[:15]]))], "query_id int, query_embedding array<double>")
    everything = stored.unionByName(extra)
    want = sorted(map(tuple, knn_join(everything, queries, 5).select("query_id", "rank", "title", "distance").collect()))
    titles = sorted(r[2] for r in ROWS + more if r[3] is not None)
    for _ in range(2):
        ivf.ivf_rebalance(spark, path)
        table = ivf.ivf_open(spark, path)
        assert sorted(r.title for r in ivf.ivf_rows(spark, path).select("title").collect()) == titles
        rows = ivf._rows(table).groupBy("cell").agg(F.count("*").alias("n"), F.min("toward").alias("t")).collect()
        assert {r.cell: (r.n_rows, r.toward) for r in ivf.ivf_reach(table).collect()} == {r.cell: (r.n, r.t) for r in rows}
        assert {r.cell for r in rows} - {ivf.NO_CELL} <= {r.cell for r in ivf._centroids(table).collect()}
        for found in (ivf.ivf_search_batch_exact(spark, table, queries), ivf.ivf_search_batch(spark, path, queries, nprobe=10**6)):
            assert sorted(map(tuple, found.select("query_id", "rank", "title", "distance").collect())) == want
        recall = ivf.ivf_recall(knn_join(everything, queries, 5), ivf.ivf_search_batch(spark, path, queries), ["title"])
        assert recall.agg(F.avg("recall")).first()[0] >= 0.9
        # What is added from now on goes to the new cells.
        ivf.ivf_append(spark.createDataFrame([("z", "00:00", "zz", far[0].tolist())], SCHEMA), path, "last")
        assert ivf.ivf_rows(spark, path).filter("title = 'zz'").count() == 1
        ivf.ivf_append(extra.limit(0), path, "last")
    assert table.about.retired and len(table.rows) > 2
    largest = sorted((r.n_rows for r in ivf.ivf_cells(spark, path).collect() if r.cell >= 0), reverse=True)
    assert largest[2] < uneven / 2  # the two largest hold copies of one vector


def test_prompts_by_both_indexes(spark, tmp_path):
    draw = np.random.default_rng(3)
    pick = lambda: (CENTRES[draw.integers(40)] + 0.1 * draw.normal(size=16)).tolist()
    rows = [(f"p{i:04}", f"gs://b/{i}", f"text {i}", pick() if i % 9 else None, pick() if i % 11 else [], None) for i in range(900)]
    spark.createDataFrame(rows, PROMPTS).write.parquet(f"{tmp_path}/prompts")
    prompts = spark.read.schema(PROMPTS).parquet(f"{tmp_path}/prompts")
    paths = [f"{tmp_path}/{c}" for c in ("video_embedding", "prompt_embedding")]
    for path in paths:
        ivf.ivf_build(prompts, path, path.rsplit("/", 1)[1])
    queries = spark.createDataFrame([(i, pick()) for i in range(20)] + [(20, [0.0] * 16)], "query_id int, query_embedding array<double>")
    got, want = ivf.ivf_prompt_search_batch(spark, *paths, queries), prompt_search_batch(prompts, queries)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
