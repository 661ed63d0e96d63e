"""Registered queries of the operators that search vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import hard_negatives, max_score
from clipatlas.llm.registry import query, table
from clipatlas.workdir import work_folder

_FINE = "embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)"

NEGATIVES_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND {_FINE}),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER best::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER best <= 3
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives of all rows whose id is divisible by 50, against all rows."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    vectors = hard_negatives.store_vectors(rows, work_folder(spark, "negatives"))
    return hard_negatives.mine_hard_negatives(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0))


TOP_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_FINE}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER best::INTEGER AS rank, vec_id, score FROM pairs
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""


@query("op12_max_score", TOP_SQL)
def max_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for all rows whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return max_score.top_inner_products(spark, rows, rows.where(F.col("vec_id") % 20 == 0))
