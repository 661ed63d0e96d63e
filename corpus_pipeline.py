"""A corpus made ready for training: five stages over documents, each on all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import byte_pairs, decontamination, language, near_duplicates, passages, quality, vocabulary
from clipatlas.workdir import settings, work_folder

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text that a task of the last stage encodes at a time.
BLOCK_CHARS = 1 << 22
#: What goes to a worker of that stage at once; Spark's own limit is 64 MB.
BATCH_BYTES = "4m"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labels outside the fold crc32(doc_id) mod 5 = 0."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(language.fold(F.col("doc_id"), 5) != 0)
    words = quality.learn_vectors(docs)
    network = quality.learn_quality(spark, docs, labels, words)
    (score,) = passages.unused_names(docs, "quality_score")
    scored = quality.score_quality(spark, docs, words, network, score)
    return scored.where(F.col(score) >= quality.ACCEPTED).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id. Rows without doc_id stay."""
    groups = near_duplicates.near_duplicate_groups(spark, docs, work_folder(spark, "pipeline-near"))
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has."""
    spans = passages.whole_repeats(spark, docs, work_folder(spark, "pipeline-passages"))
    return passages.without_repeats(docs, spans)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Rows without doc_id are known by their text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (key,) = passages.unused_names(docs, "_key")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256))))
    found = decontamination.contained_items(spark, keyed.select(F.col(key).alias("doc_id"), "text"), items, work_folder(spark, "pipeline-contained"))
    return keyed.join(found.select(F.col("doc_id").alias(key)).distinct(), key, "left_anti").select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and the digests of the ids and of the bytes they decode to.

    The ids are stored before they are decoded, so that a task has one Python worker at a time: workers wait for the
    next stage with what memory they have.
    """
    sent = vocabulary.send(spark, public_tokenizers.path(RANKS))
    folder = work_folder(spark, "pipeline-encoded")
    with settings(spark, execution__arrow__maxBytesPerBatch=BATCH_BYTES):
        byte_pairs.encode(docs, sent, public_tokenizers.PATTERN, BLOCK_CHARS).write.parquet(folder)
    encoded = spark.read.parquet(folder)
    return byte_pairs.decode(encoded, sent).select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("substring dedup", passage_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", encoding_stage),
]

#: The first stage is a fitted network, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table that the next stage reads."""
    folder = work_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
