"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node it sees to its larger neighbours."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    root: Column = F.least("src", "least")
    return both.join(least, "src").where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), root.alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest of its smaller neighbours to the others and to itself."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    others = edges.join(least, "src").where(F.col("dst") != F.col("least")).select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return others.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def connected_components(spark: SparkSession, links: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) for every node with a link; ``links`` has two integer columns a, b.

    Each round is written as a table below ``folder``, so lineage stays short and a lost executor costs one
    step. Nodes with many links are no hot task: minima are partially aggregated and the joins can be split.
    The driver sees two counts a round. Links of a node with itself and links with a null are left out.
    """
    edges = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    )
    turn = 0
    while True:
        edges.write.parquet(f"{folder}/{turn}")
        edges = spark.read.parquet(f"{folder}/{turn}")
        if turn:
            roots = edges.select(F.col("dst").alias("src")).distinct()
            chained = edges.join(roots, "src", "left_semi").select("src")
            split = edges.groupBy("src").count().where(F.col("count") > 1).select("src")
            if chained.unionByName(split).isEmpty():
                break
        turn += 1
        edges = _small_star(_large_star(edges))
    roots = edges.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
