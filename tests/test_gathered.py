"""Nearest-neighbour joins of many queries: each different vector is scored once, and few copies of the rows are dealt."""

import numpy as np
import pytest
from test_knn import SCHEMA, brute, listed, make_rows

from clipatlas.operators import ivf, knn
from clipatlas.operators.knn import knn_join


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = make_rows(rng, 300)
    # Each vector three times more, under titles that come before and after.
    rows += [(r[0], r[1], f"{'s' if n < 2 else 'u'}{i:05}{n}", f"copy {i}", r[4]) for i, r in enumerate(rows) for n in range(3)]
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(40)]
    queries += [(100, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]), (101, [0.0] * 6)]
    return rows, queries, spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(queries, "query_id int, query_embedding array<double>")


@pytest.fixture
def stored(monkeypatch):
    """What is written to the work folder: rows of each table by its purpose."""
    tables, written = {}, knn.written

    def seen(df, purpose):
        table = written(df, purpose)
        tables[purpose] = table.count()
        return table

    monkeypatch.setattr(knn, "written", seen)
    monkeypatch.setattr(knn, "GATHER_FROM", 0, raising=False)
    return tables


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block_bytes", [12_000, 1 << 26])
@pytest.mark.parametrize("key", [None, ["title"]])
def test_each_vector_is_scored_once(data, stored, metric, block_bytes, key):
    rows, queries, base, vectors = data
    assert listed(knn_join(base, vectors, 5, metric, block_bytes=block_bytes, key=key)) == brute(rows, queries, 5, metric)
    assert stored["vectors"] == len({tuple(r[4]) for r in rows if r[4] and len(r[4]) == 6})


def test_rows_that_share_no_vector_are_not_gathered(spark, stored):
    rng = np.random.default_rng(6)
    rows = [("v", "0", f"t{i:04}", "", [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(9)]
    found = knn_join(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, "query_id int, query_embedding array<double>"), 5)
    assert listed(found) == brute(rows, queries, 5, "cosine") and "vectors" not in stored


@pytest.mark.parametrize("held", [1 << 26, 30_000])
def test_rows_are_not_copied_for_every_small_block(data, monkeypatch, held):
    rows, queries, base, vectors = data
    blocks, deal = [], knn.deal
    monkeypatch.setattr(knn, "QUERY_BLOCK_BYTES", held)
    monkeypatch.setattr(knn, "deal", lambda some, n_chunks, asked, n_blocks: blocks.append(n_blocks) or deal(some, n_chunks, asked, n_blocks))
    assert listed(knn_join(base, vectors, 5, block_bytes=4_000)) == brute(rows, queries, 5, "cosine")
    size = len(queries) * (6 * 8 + 5 * knn._COLUMN_BYTES * 4)
    assert blocks == [-(-2 * size // held)]


def test_cells_hold_their_own_vectors(data, spark, stored, tmp_path):
    rows, queries, base, vectors = data
    base.filter("size(embedding) = 6").write.parquet(f"{tmp_path}/rows")
    ivf.ivf_build(spark.read.parquet(f"{tmp_path}/rows"), f"{tmp_path}/cells", nlist=8)
    found = ivf.ivf_search_batch_exact(spark, f"{tmp_path}/cells", vectors, nprobe=2)
    assert listed(found.select("query_id", "rank", "timestamp_start", "title", "note", "distance")) == brute(rows, queries, 5, "cosine")
    assert stored["vectors"] > 0


def test_cells_that_spare_nothing_are_not_listed(spark, tmp_path, monkeypatch):
    """Where the nearest rows lie in most cells, no list of cells is made for each query."""
    rng = np.random.default_rng(7)
    rows = [("v", "0", f"t{i:04}", f"note {i}", [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(9)]
    monkeypatch.setattr(ivf, "_measured_probes", lambda table: 5)
    ivf.ivf_build(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/cells", nlist=8)
    asked, listing = [], ivf._asked
    monkeypatch.setattr(ivf, "_asked", lambda *given: asked.append(given) or listing(*given))
    vectors = spark.createDataFrame(queries, "query_id int, query_embedding array<double>")
    for nprobe in (None, 5):
        found = ivf.ivf_search_batch_exact(spark, f"{tmp_path}/cells", vectors, nprobe=nprobe)
        assert listed(found.select("query_id", "rank", "timestamp_start", "title", "note", "distance")) == brute(rows, queries, 5, "cosine")
        assert len(asked) == (nprobe is not None)
