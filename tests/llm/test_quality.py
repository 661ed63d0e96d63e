"""The quality classifier: held-out accuracy, and edge tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipatlas.llm import quality
from clipatlas.llm.language import fold


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    words = quality.learn_vectors(docs)
    return docs, labels, words, quality.learn_quality(spark, docs, labels.where(fold(F.col("doc_id"), 5) != 0), words)


def test_held_out_accuracy(spark, learned):
    docs, labels, words, network = learned
    rows = quality.score_quality(spark, docs, words, network).join(labels.where(fold(F.col("doc_id"), 5) == 0), "doc_id").collect()
    right = [(r["quality_score"] >= quality.ACCEPTED) == (r["quality"] == 1) for r in rows]
    assert sum(right) >= 0.9 * len(rows)
    assert all(0 <= r["quality_score"] <= 1 for r in rows)


def test_vectors_do_not_depend_on_the_partitions(spark, learned):
    docs, _, words, _ = learned
    again = quality.learn_vectors(docs.repartition(7, "doc_id"))
    assert np.allclose(words.weights, again.weights) and np.allclose(words.vectors, again.vectors, atol=1e-6)


def test_context_sums_against_brute_force(spark):
    texts = ["a b c", "b a", "", None, "a", "x y " * 40000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = quality.learn_vectors(docs)
    sparse = quality._sparse_vectors()
    read = quality._reader()
    total = np.zeros((quality.SLOTS, quality.WIDTH))
    for t in texts:
        ids = read(t)
        for d in (-2, -1, 1, 2):
            mine, near = (ids[-d:], ids[:d]) if d < 0 else (ids[:-d], ids[d:])
            np.add.at(total, mine, sparse[near])
    length = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(words.vectors, total / np.where(length > 0, length, 1), atol=1e-6)


def test_edges(spark, learned):
    _, _, words, network = learned
    rows = [(1, None, 9.0), (2, "", 9.0), (3, "word " * 200_000, 9.0), (3, "word " * 200_000, 9.0), (None, "word", 9.0), (4, "!!! ###", 9.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    scored = quality.score_quality(spark, docs, words, network)
    assert scored.columns == ["doc_id", "text", "quality_score"]
    got = scored.collect()
    assert len(got) == 6 and all(0 <= r["quality_score"] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add(r["quality_score"])
    assert by_id[1] == by_id[2] and len(by_id[3]) == 1
    assert quality.score_quality(spark, docs.limit(0), words, network).count() == 0


def test_labels_missing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c")], "doc_id long, text string")
    words = quality.learn_vectors(docs)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for labels, share in ((none, 0.5), (one, 1.0)):
        network = quality.learn_quality(spark, docs, labels, words)
        assert {round(r["quality_score"], 3) for r in quality.score_quality(spark, docs, words, network).collect()} == {share}
    assert np.all(quality.learn_vectors(docs.limit(0)).vectors == 0)


def test_temperature_and_layers():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, quality.FEATURES)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    network = quality.fit_network(x, y, np.arange(600) % 5 == 0)
    assert network.temperature > 0 and ((network.scores(x) > 0.5) == y).mean() > 0.9
