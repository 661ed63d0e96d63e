"""Registered queries of the operators that run on column expressions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import decontamination, licenses, order_minhash
from clipatlas.llm.registry import query, table
from clipatlas.workdir import work_folder


@query("op2_order_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    return order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op4_licenses")
def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree: a directory for 1,000 ids, and in it one for 100.

    The first id of a directory is its licence file.
    """
    thousand, hundred = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    name = F.when(F.col("doc_id") % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    inner = F.when(F.col("doc_id") % 1000 == 0, F.lit("")).otherwise(F.concat(hundred % 10, F.lit("/")))
    path = F.concat(F.lit("/t"), thousand, F.lit("/"), inner, name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan_licenses(spark, files, work_folder(spark, "licenses"))


CONTAINED_SQL = """
WITH cut AS (
  SELECT 'd' AS side, doc_id AS id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')
  FROM benchmark WHERE text IS NOT NULL),
runs AS (
  SELECT DISTINCT side, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s
  FROM cut WHERE NOT (len(w) = 1 AND w[1] = '')),
sizes AS (SELECT id, count(*) AS item_shingles FROM runs WHERE side = 'i' GROUP BY id),
held AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM runs d JOIN runs i ON d.s = i.s AND d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment
FROM held JOIN sizes ON id = item_id WHERE shared >= 0.75 * item_shingles
"""


@query("op6_decontamination", CONTAINED_SQL)
def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contained_items(spark, docs, items, work_folder(spark, "contained"))
