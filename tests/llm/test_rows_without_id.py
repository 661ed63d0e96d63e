"""Benchmark items in documents without doc_id."""

import corpus_pipeline


def test_decontamination_of_rows_without_id(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(None, f"before {item} after"), (None, "clean text of a few words"), (None, None), (1, item), (2, "clean as well")]
    left = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(map(str, left)) == sorted(map(str, corpus_pipeline_rows(spark, [rows[1], rows[2], rows[4]])))


def corpus_pipeline_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").collect()
