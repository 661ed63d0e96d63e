"""Searches over the scene table and the prompt table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from clipatlas.functions.labels import tags_split
from clipatlas.functions.links import prompt_video_url, scene_video_url
from clipatlas.functions.vectors import distance_to, usable
from clipatlas.operators.knn import SCENE_ORDER, distance_of, knn_join, nearest
from clipatlas.schemas import SCENE_TEXT_COLUMNS
from clipatlas.sources.tables import ROW_PLACE, read_scenes, with_place

# How many results a search returns.
SCENE_RESULTS = 5
PROMPT_RESULTS = 3
PROMPT_BRANCH_RESULTS = 3

PROMPT_VECTORS = ("video_embedding", "prompt_embedding")
PROMPT_COLUMNS = ["id", "gcs_video_path", "prompt_text", "created_at"]


def scene_results(hits: DataFrame, bucket: str | None = None, lead: Sequence[str] = ()) -> DataFrame:
    """Shape found scenes for display: text columns, split tags, video address, both scores."""
    return hits.select(
        *lead,
        *[tags_split(F.col(c)).alias(c) if c == "tags" else c for c in SCENE_TEXT_COLUMNS],
        scene_video_url(F.col("source"), F.col("video_id"), bucket).alias("video_url"),
        "distance",
        (F.lit(1.0) - F.col("distance")).alias("similarity"),
    )


def scene_search(
    scenes: DataFrame,
    query: Sequence[float],
    k: int = SCENE_RESULTS,
    metric: str = "cosine",
    bucket: str | None = None,
) -> DataFrame:
    """The ``k`` scenes nearest to a query vector, best first.

    Ties are ranked by ``video_id, timestamp_start, title``. ``similarity`` is 1 - distance, which
    is the cosine similarity for the cosine metric.
    """
    return scene_results(nearest(scenes, query, k, metric), bucket)


def scene_search_stored(
    spark: SparkSession,
    path: str,
    query: Sequence[float],
    k: int = SCENE_RESULTS,
    metric: str = "cosine",
    bucket: str | None = None,
) -> DataFrame:
    """``scene_search`` on a stored table, by ``scene_search_places``."""
    return scene_search_places(with_place(read_scenes(spark, path)), query, k, metric, bucket)


def scene_search_places(
    stored: DataFrame,
    query: Sequence[float],
    k: int = SCENE_RESULTS,
    metric: str = "cosine",
    bucket: str | None = None,
) -> DataFrame:
    """``scene_search`` in two steps, on stored scenes with their place.

    The first reads the vectors and the tie-break columns only and finds where the winners lie. The
    second reads the text columns of the at most ``k`` files that hold a winner.
    """
    return scenes_at(stored, nearest_places(stored, query, k, metric), bucket)


def nearest_places(stored: DataFrame, query: Sequence[float], k: int, metric: str = "cosine") -> list[Row]:
    """Where the ``k`` nearest of stored scenes lie, best first, with what ranks them."""
    narrow = stored.select(*ROW_PLACE, *SCENE_ORDER, "embedding")
    return nearest(narrow, query, k, metric, closeness=True).collect()


def scenes_at(stored: DataFrame, found: Sequence[Row], bucket: str | None = None) -> DataFrame:
    """The scenes at the places that ``nearest_places`` gives, in their order."""
    places = [(*(place[c] for c in (*ROW_PLACE, "distance")), rank) for rank, place in enumerate(found)]
    files = sorted({place[0] for place in places})
    winners = stored.sparkSession.createDataFrame(places, "_file string, _row bigint, distance double, _rank int")
    rows = stored.filter(F.col("_file").isin(files)).drop("embedding")
    return scene_results(rows.join(F.broadcast(winners), ROW_PLACE).orderBy("_rank"), bucket)


def scene_search_batch(
    scenes: DataFrame,
    queries: DataFrame,
    k: int = SCENE_RESULTS,
    metric: str = "cosine",
    bucket: str | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """``scene_search`` for a table of queries ``(query_id, query_embedding)``, in one job.

    ``key`` keeps the text columns out of the scoring; for stored scenes it can be ``ROW_PLACE``.
    """
    hits = knn_join(scenes, queries, k, metric, key=key)
    return scene_results(hits, bucket, lead=["query_id", "rank"])


def prompt_matches(prompts: DataFrame, query: Sequence[float]) -> DataFrame:
    """Distance of every prompt by video vector and by text vector, in one scan.

    A missing vector gives no row.
    """
    branches = [
        F.struct(F.lit(c).alias("matched_on"), _cosine_or_null(c, query).alias("distance")) for c in PROMPT_VECTORS
    ]
    scored = prompts.select(*PROMPT_COLUMNS, F.inline(F.array(*branches)))
    return scored.filter(F.col("distance").isNotNull())


def search_candidates(
    prompts: DataFrame,
    query: Sequence[float],
    branch_k: int = PROMPT_BRANCH_RESULTS,
    by_text: DataFrame | None = None,
) -> DataFrame:
    """Nearest prompts by video vector and by text vector, one below the other, duplicates kept.

    ``by_text`` gives other rows for the second search, such as those of another clustered table.
    """

    return _candidates(prompts, query, branch_k, by_text).drop("_close")


def _candidates(prompts: DataFrame, query: Sequence[float], branch_k: int, by_text: DataFrame | None) -> DataFrame:
    def branch(rows: DataFrame, vec_col: str) -> DataFrame:
        narrow = rows.select(*PROMPT_COLUMNS, vec_col)
        hits = nearest(narrow, query, branch_k, vec_col=vec_col, order=("id",), closeness=True)
        return hits.select(*PROMPT_COLUMNS, F.lit(vec_col).alias("matched_on"), "distance", "_close")

    by_video, by_prompt = PROMPT_VECTORS
    return branch(prompts, by_video).unionByName(branch(prompts if by_text is None else by_text, by_prompt))


def best_match_per_id(matches: DataFrame) -> DataFrame:
    """One row per id with its smallest distance."""
    return matches.groupBy("id").agg(
        F.any_value("gcs_video_path").alias("gcs_video_path"),
        F.any_value("prompt_text").alias("prompt_text"),
        F.any_value("created_at").alias("created_at"),
        F.min("distance").alias("best_distance"),
    )


def _closest_per(matches: DataFrame, *by: str) -> DataFrame:
    """One row per id, and per column of ``by``, with its largest closeness, which ranks it."""
    columns = [F.any_value(c).alias(c) for c in PROMPT_COLUMNS if c != "id"]
    return matches.groupBy(*by, "id").agg(*columns, F.max("_close").alias("_close"))


def _prompt_results(best: DataFrame, k: int) -> DataFrame:
    top = best.orderBy(F.desc("_close"), "id").limit(k).withColumn("best_distance", distance_of("_close")).drop("_close")
    return top.withColumn("video_url", prompt_video_url(F.col("gcs_video_path")))


def prompt_search(
    prompts: DataFrame,
    query: Sequence[float],
    branch_k: int = PROMPT_BRANCH_RESULTS,
    k: int = PROMPT_RESULTS,
    by_text: DataFrame | None = None,
) -> DataFrame:
    """Prompts whose video or text vector is nearest to the query vector, best first."""
    return _prompt_results(_closest_per(_candidates(prompts, query, branch_k, by_text)), k)


def _cosine_or_null(vec_col: str, query: Sequence[float]) -> Column:
    return F.when(usable(F.col(vec_col), len(query)), distance_to(F.col(vec_col), query))


def prompt_search_single_pass(prompts: DataFrame, query: Sequence[float], k: int = PROMPT_RESULTS) -> DataFrame:
    """``prompt_search`` in one scan, for unique ids and a ``branch_k`` of at least ``k``.

    Both vectors of a prompt become rows of one table. An id has two of them at most, so the ids of the best
    ``2 * k`` rows hold the best ``k`` ids.
    """
    both = F.explode(F.array(*[F.col(c).cast("array<double>") for c in PROMPT_VECTORS]))
    rows = prompts.select(*PROMPT_COLUMNS, both.alias("vector"))
    hits = nearest(rows, query, 2 * k, vec_col="vector", order=("id",), closeness=True)
    return _prompt_results(_closest_per(hits), k)


def prompt_search_batch(
    prompts: DataFrame,
    queries: DataFrame,
    branch_k: int = PROMPT_BRANCH_RESULTS,
    k: int = PROMPT_RESULTS,
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
) -> DataFrame:
    """``prompt_search`` for a table of queries, in one job per vector column."""
    found = [
        knn_join(
            prompts.select(*PROMPT_COLUMNS, c), queries, branch_k, base_col=c,
            query_id=query_id, query_vec=query_vec, order=("id",), closeness=True,
        )
        for c in PROMPT_VECTORS
    ]
    return best_prompts(found[0].unionByName(found[1]), k, query_id)


def best_prompts(matches: DataFrame, k: int, query_id: str) -> DataFrame:
    """From matches by either vector the ``k`` best prompts of each query."""
    best = _closest_per(matches, query_id)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("_close"), "id"))
    top = best.withColumn("rank", place.cast("bigint")).filter(F.col("rank") <= k)
    top = top.withColumn("best_distance", distance_of("_close")).drop("_close")
    return top.withColumn("video_url", prompt_video_url(F.col("gcs_video_path")))


def prompt_search_score(distance: Column) -> Column:
    """Shown score: 1 - distance to three places; a missing distance counts as 0."""
    return F.round(F.lit(1.0) - F.coalesce(distance, F.lit(0.0)), 3)
