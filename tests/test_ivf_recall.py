"""The cells that a search looks into by itself find nine in ten of the nearest vectors."""

import numpy as np
from pyspark.sql import functions as F

from clipatlas.operators import ivf
from clipatlas.operators.knn import knn_join


def test_measured_probes(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(f"v{i}", "00:00", f"t{i}", v.tolist()) for i, v in enumerate(draw.normal(size=(2000, 32)))]
    spark.createDataFrame(rows, "video_id string, timestamp_start string, title string, embedding array<double>").write.parquet(f"{tmp_path}/rows")
    stored = spark.read.parquet(f"{tmp_path}/rows")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(100, 32)))], "query_id long, query_embedding array<double>")
    ivf.ivf_build(stored, f"{tmp_path}/cells")
    recall = ivf.ivf_recall(knn_join(stored, queries, k=5), ivf.ivf_search_batch(spark, f"{tmp_path}/cells", queries), ["title"])
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9
