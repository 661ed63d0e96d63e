"""Registered queries of the operators that compare documents or shuffle what is in them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import byte_pairs, near_duplicates, passages, vocabulary
from clipatlas.llm.registry import query, table
from clipatlas.workdir import work_folder

RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op1_near_duplicates")
def near_duplicates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies that each document belongs to."""
    return near_duplicates.near_duplicate_groups(spark, table(spark, sf_dir, "documents"), work_folder(spark, "near"))


@query("op7_repeated_passages")
def passages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents that repeat an earlier passage."""
    spans = passages.whole_repeats(spark, table(spark, sf_dir, "documents"), work_folder(spark, "passages"))
    return spans.select("doc_id", "start", "stop", "words", "first_doc_id")


@query("op8_byte_pairs")
def byte_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to, as digests."""
    sent = vocabulary.send(spark, public_tokenizers.path(RANKS))
    encoded = byte_pairs.encode(table(spark, sf_dir, "documents"), sent, public_tokenizers.PATTERN)
    return byte_pairs.decode(encoded, sent).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
