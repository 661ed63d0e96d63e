"""Registered queries of the operators that take each document by itself."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import language, quality, sharding, token_counts, vocabulary
from clipatlas.llm.registry import query, table
from clipatlas.workdir import work_folder

SHARDS = 16
#: The vocabulary has 50,256 ids from 0; this one is free.
END_ID = 50256
RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op3_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as flat token files without an index, and the counts that a separator scan finds in them."""
    folder = work_folder(spark, "tokens")
    sent = vocabulary.send(spark, public_tokenizers.path(RANKS))
    docs = table(spark, sf_dir, "documents")
    written = token_counts.write_flat_files(docs, f"{folder}/flat", sent, public_tokenizers.PATTERN, END_ID)
    written.write.parquet(f"{folder}/order")
    order = spark.read.parquet(f"{folder}/order")
    named = order.select("path").distinct()
    name = F.substring_index("path", "/", -1)
    files = (
        token_counts.list_files(spark, f"{folder}/flat").withColumn("name", name)
        .join(named.select(name.alias("name")).hint("merge"), "name", "left_semi").select("path", "length")
    )
    found = token_counts.count_tokens(files, END_ID)
    return (
        order.select(name.alias("name"), "place", "doc_id")
        .join(found.withColumn("name", F.substring_index("path", "/", -1)).drop("path").hint("merge"), ["name", "place"], "left")
        .select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.col("name").alias("file"), "place", F.col("first").alias("first_token"), "ended")
    )


@query("op5_jump_shards")
def shards_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all documents by jump consistent hashing, and their shard of 17."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)


@query("op9_quality")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; labels of the fold crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = quality.learn_vectors(docs)
    network = quality.learn_quality(spark, docs, labels.where(language.fold(F.col("doc_id"), 5) != 0), words)
    return quality.score_quality(spark, docs.select("doc_id", "text"), words, network).select(
        "doc_id",
        (language.fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= quality.ACCEPTED, 1).otherwise(0).alias("predicted"),
    )


@query("op10_language")
def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; rows of the fold crc32(doc_id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold(F.col("doc_id"), 3) == 1
    dictionaries = language.learn_dictionaries(docs.where(~held_out))
    return language.identify(spark, docs, dictionaries).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
