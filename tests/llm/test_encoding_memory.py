"""What tasks of the encoding stage hold."""

import public_tokenizers

import corpus_pipeline
from clipatlas.llm import byte_pairs, vocabulary

ROWS = [(d, f"some words of row {d}, " * (d % 7) + "l'été 日本語 🙂" * (d % 3)) for d in range(60)] + [(None, None), (7, "x")]


def test_a_task_has_one_python_worker(spark, sf):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = corpus_pipeline.encoding_stage(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_small_blocks_give_the_same_ids(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    sent = vocabulary.send(spark, public_tokenizers.path(corpus_pipeline.RANKS))
    whole, small = (
        sorted(map(repr, byte_pairs.encode(docs, sent, public_tokenizers.PATTERN, *size).collect())) for size in ((), (100,))
    )
    assert small == whole and len(small) == len(ROWS)


def test_workers_get_small_batches(spark, sf, monkeypatch):
    limit, seen, encode = "spark.sql.execution.arrow.maxBytesPerBatch", [], byte_pairs.encode
    before = spark.conf.get(limit)
    monkeypatch.setattr(byte_pairs, "encode", lambda *given: seen.append(spark.conf.get(limit)) or encode(*given))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert corpus_pipeline.encoding_stage(spark, docs, sf).count() == len(ROWS)
    assert seen == [corpus_pipeline.BATCH_BYTES] and spark.conf.get(limit) == before
