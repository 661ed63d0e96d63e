"""Clustered tables searched exactly, joins dealt out, and libraries of batches that come and go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.library import Library
from clipatlas.operators import ivf, knn, stats
from clipatlas.operators.embed import HASH_DIMS, embed_once
from clipatlas.operators.search import PROMPT_VECTORS
from clipatlas.plans.ingest_queries import STORED_SCENES
from clipatlas.plans.registry import CHECKS, query
from clipatlas.plans.relations import check_sql, query_vector, relation, responses
from clipatlas.plans.search_queries import index_of, prompts_found, rounded, scenes_found
from clipatlas.schemas import SCENE_TEXT_COLUMNS
from clipatlas.workdir import work_folder


@query("ivf_search_exact", CHECKS["ivf_search"])
def ivf_search_exact_query(spark: SparkSession, sf: str) -> DataFrame:
    """Opening only the cells that may hold one of the nearest, which has to give the exact result."""
    return scenes_found(ivf.ivf_search_exact(spark, index_of(spark, sf), query_vector(spark, sf), bucket="bucket"))


@query("ivf_search_batch_exact", CHECKS["ivf_search_batch"])
def ivf_search_batch_exact_query(spark: SparkSession, sf: str) -> DataFrame:
    """As ``ivf_search_exact`` for every vector as a query, in two joins."""
    found = ivf.ivf_search_batch_exact(spark, index_of(spark, sf), relation(spark, sf, "query_vectors"), key=["title"])
    return rounded(found.select("query_id", "rank", "video_id", "timestamp_start", "title", "distance"), "distance")


@query("ivf_prompt_search_batch", CHECKS["prompt_search_batch"])
def ivf_prompt_search_batch_query(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts by both of their clustered tables, the second opened only where the first leaves room."""
    tables = [index_of(spark, sf, "prompts", c) for c in PROMPT_VECTORS]
    return prompts_found(ivf.ivf_prompt_search_batch(spark, *tables, relation(spark, sf, "query_vectors")))


@query("knn_join_dealt", CHECKS["knn_join"])
def knn_join_dealt(spark: SparkSession, sf: str) -> DataFrame:
    """More queries than are sent to all tasks: blocks of them and chunks of rows, dealt by a shuffle."""
    scenes = relation(spark, sf, "scenes", heavy=True).select("video_id", "timestamp_start", "title", "embedding")
    vectors = relation(spark, sf, "query_vectors")
    return rounded(knn.knn_join(scenes, vectors, k=5, block_bytes=256 << 10), "distance")


@query("stats_kept_up", CHECKS["stats"])
def stats_kept_up(spark: SparkSession, sf: str) -> DataFrame:
    """All figures from those of seven batches, added up without reading a scene again."""
    scenes, folder = relation(spark, sf, "scenes"), work_folder(spark, "figures")
    parts = F.pmod(F.xxhash64("title"), F.lit(7))
    for part in range(7):
        stats.partial_figures(scenes.filter(parts == part)).write.parquet(f"{folder}/{part}")
    partials = spark.read.schema(stats.FIGURES).parquet(*[f"{folder}/{part}" for part in range(7)])
    return stats.stats_of(partials, relation(spark, sf, "prompts"))


@query(
    "embed_once",
    check_sql("SELECT title, length(description)::DOUBLE AS n_chars, len(string_split(description, ' '))::DOUBLE AS n_words FROM scenes", "scenes"),
)
def embed_once_query(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions by a model that is given each of them once; the model measures a text."""

    def load():
        return lambda texts: [[float(len(t)), float(len(t.split(" ")))] for t in texts]

    vectors = embed_once(relation(spark, sf, "scenes", heavy=True).select("title", "description"), "description", "v", load)
    return vectors.select("title", F.get("v", F.lit(0)).alias("n_chars"), F.get("v", F.lit(1)).alias("n_words"))


@query(
    "library_batches",
    check_sql(f"SELECT {STORED_SCENES[0]}, {HASH_DIMS} AS dims {STORED_SCENES[1]}", "scenes", "documents_of"),
)
def library_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Responses in three batches, one of them stored wrongly first and an index in between, as the commits tell."""
    library = Library(spark, work_folder(spark, "library"))
    documents = responses(spark, sf)
    part = F.pmod(F.xxhash64("response_id"), F.lit(3))
    library.add_responses(documents.filter(part != 1), batch="0")
    library.build_index()
    for number in range(3):
        library.add_responses(documents.filter(part == number), batch=str(number))
    return library.scenes.select(*SCENE_TEXT_COLUMNS, F.size("embedding").alias("dims"))
