"""Vector scoring, searches and clustered search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.functions.vectors import (
    cosine_distance,
    cosine_similarity,
    decode_embedding,
    distance_to,
    encode_embedding,
    euclidean_distance,
    usable,
)
from clipatlas.operators import ivf
from clipatlas.operators.knn import knn_join
from clipatlas.operators.search import (
    PROMPT_VECTORS,
    best_match_per_id,
    prompt_matches,
    prompt_search,
    prompt_search_batch,
    prompt_search_score,
    prompt_search_single_pass,
    scene_search,
    scene_search_batch,
    scene_search_stored,
    search_candidates,
)
from clipatlas.plans.registry import query
from clipatlas.plans.relations import (
    QUERY_VEC_ID,
    check_sql,
    query_vector,
    relation,
    stored_scenes,
)
from clipatlas.schemas import SCENE_TEXT_COLUMNS
from clipatlas.sources.tables import ROW_PLACE, read_scenes, with_place
from clipatlas.workdir import work_folder

_HOST = "https://storage.mtls.cloud.google.com/"
_Q = f"(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {QUERY_VEC_ID})"
_ORDER = "video_id, timestamp_start, title"
_URL = f"""CASE WHEN source LIKE 'gs://%' THEN '{_HOST}' || replace(source, 'gs://', '')
  WHEN source = 'gcs' THEN '{_HOST}bucket/' || video_id ELSE coalesce(source, '') END"""
_TEXT = ", ".join("replace(coalesce(tags, ''), ',', '|') AS tags" if c == "tags" else c for c in SCENE_TEXT_COLUMNS)


def _cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _euclidean(a: str, b: str) -> str:
    return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def scenes_found(results: DataFrame) -> DataFrame:
    return rounded(results, "distance", "similarity").withColumn("tags", F.array_join("tags", "|"))


def _scene_search_check(distance: str) -> str:
    return check_sql(
        f"""SELECT {_TEXT}, {_URL} AS video_url, round(d, 6) + 0 AS distance, round(1 - d, 6) + 0 AS similarity
        FROM (SELECT *, {distance} AS d FROM scenes)
        ORDER BY d, {_ORDER} LIMIT 5""",
        "scenes",
    )


_COSINE_SEARCH = _scene_search_check("1 - " + _cosine("embedding", _Q))


@query("scene_search", _COSINE_SEARCH)
def scene_search_query(spark: SparkSession, sf: str) -> DataFrame:
    return scenes_found(scene_search(relation(spark, sf, "scenes", heavy=True), query_vector(spark, sf), bucket="bucket"))


@query("euclidean_search", _scene_search_check(_euclidean("embedding", _Q)))
def euclidean_search(spark: SparkSession, sf: str) -> DataFrame:
    scenes = relation(spark, sf, "scenes", heavy=True)
    return scenes_found(scene_search(scenes, query_vector(spark, sf), metric="euclidean", bucket="bucket"))


@query("scene_search_stored", _COSINE_SEARCH)
def scene_search_stored_query(spark: SparkSession, sf: str) -> DataFrame:
    path = stored_scenes(spark, sf)
    return scenes_found(scene_search_stored(spark, path, query_vector(spark, sf), bucket="bucket"))


@query(
    "usable_embedding",
    check_sql("SELECT title, len(embedding) AS dims FROM scenes WHERE len(embedding) > 0", "scenes"),
)
def usable_embedding(spark: SparkSession, sf: str) -> DataFrame:
    scenes = relation(spark, sf, "scenes").filter(usable(F.col("embedding")))
    return scenes.select("title", F.size("embedding").cast("bigint").alias("dims"))


def _pairwise(name: str, expression: str) -> str:
    return check_sql(f"SELECT id, round({expression}, 6) + 0 AS {name} FROM prompts", "prompts")


@query("cosine_similarity", _pairwise("similarity", _cosine("video_embedding", "prompt_embedding")))
def cosine_similarity_query(spark: SparkSession, sf: str) -> DataFrame:
    score = cosine_similarity(F.col("video_embedding"), F.col("prompt_embedding"))
    return relation(spark, sf, "prompts").select("id", F.round(score, 6).alias("similarity"))


@query("cosine_distance", _pairwise("distance", "1 - " + _cosine("video_embedding", "prompt_embedding")))
def cosine_distance_query(spark: SparkSession, sf: str) -> DataFrame:
    score = cosine_distance(F.col("video_embedding"), F.col("prompt_embedding"))
    return relation(spark, sf, "prompts").select("id", F.round(score, 6).alias("distance"))


@query("euclidean_distance", _pairwise("distance", _euclidean("video_embedding", "prompt_embedding")))
def euclidean_distance_query(spark: SparkSession, sf: str) -> DataFrame:
    score = euclidean_distance(F.col("video_embedding"), F.col("prompt_embedding"))
    return relation(spark, sf, "prompts").select("id", F.round(score, 6).alias("distance"))


@query(
    "embedding_codec",
    """SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) + 0 AS total,
       round(embedding[1]::DOUBLE, 6) + 0 AS first_value FROM embeddings""",
)
def embedding_codec(spark: SparkSession, sf: str) -> DataFrame:
    vectors = relation(spark, sf, "query_vectors")
    decoded = decode_embedding(encode_embedding(F.col("query_embedding")))
    return vectors.select(F.col("query_id").alias("vec_id"), decoded.alias("v")).select(
        "vec_id",
        F.size("v").cast("bigint").alias("dims"),
        F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x), 6).alias("total"),
        F.round(F.get("v", F.lit(0)), 6).alias("first_value"),
    )


def _join_check(distance: str, columns: str) -> str:
    return check_sql(
        f"""SELECT {columns} FROM (
          SELECT s.*, query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, {_ORDER}) AS rank
          FROM (SELECT s.*, q.query_id, {distance} AS d FROM scenes s, query_vectors q) s)
        WHERE rank <= 5""",
        "scenes",
        "query_vectors",
    )


_NARROW = "query_id, rank, video_id, timestamp_start, title, round(d, 6) + 0 AS distance"


@query("knn_join", _join_check("1 - " + _cosine("s.embedding", "q.query_embedding"), _NARROW))
def knn_join_query(spark: SparkSession, sf: str) -> DataFrame:
    scenes = relation(spark, sf, "scenes", heavy=True).select("video_id", "timestamp_start", "title", "embedding")
    return rounded(knn_join(scenes, relation(spark, sf, "query_vectors"), k=5), "distance")


@query("knn_join_euclidean", _join_check(_euclidean("s.embedding", "q.query_embedding"), _NARROW))
def knn_join_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    scenes = relation(spark, sf, "scenes", heavy=True).select("video_id", "timestamp_start", "title", "embedding")
    joined = knn_join(scenes, relation(spark, sf, "query_vectors"), k=5, metric="euclidean")
    return rounded(joined, "distance")


@query(
    "search_batch",
    _join_check(
        "1 - " + _cosine("s.embedding", "q.query_embedding"),
        f"query_id, rank, {_TEXT}, {_URL} AS video_url, round(d, 6) + 0 AS distance, round(1 - d, 6) + 0 AS similarity",
    ),
)
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    scenes = with_place(read_scenes(spark, stored_scenes(spark, sf)))
    return scenes_found(scene_search_batch(scenes, relation(spark, sf, "query_vectors"), bucket="bucket", key=ROW_PLACE))


_BRANCHES = f"""
  SELECT id, gcs_video_path, prompt_text, created_at, 'video_embedding' AS matched_on,
    1 - {_cosine("video_embedding", _Q)} AS distance FROM prompts
  UNION ALL
  SELECT id, gcs_video_path, prompt_text, created_at, 'prompt_embedding' AS matched_on,
    1 - {_cosine("prompt_embedding", _Q)} AS distance FROM prompts"""
_CANDIDATES = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY matched_on ORDER BY distance, id) AS r
  FROM ({_BRANCHES})) WHERE r <= 3"""
_CREATED = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at"


def _created() -> F.Column:
    return F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at")


@query(
    "search_candidates",
    check_sql(f"SELECT id, matched_on, round(distance, 6) + 0 AS distance FROM ({_CANDIDATES})", "prompts"),
)
def search_candidates_query(spark: SparkSession, sf: str) -> DataFrame:
    found = search_candidates(relation(spark, sf, "prompts"), query_vector(spark, sf))
    return rounded(found.select("id", "matched_on", "distance"), "distance")


@query(
    "best_match_per_id",
    check_sql(
        f"""SELECT id, any_value(gcs_video_path) AS gcs_video_path, any_value(prompt_text) AS prompt_text,
        round(min(distance), 6) + 0 AS best_distance FROM ({_BRANCHES}) GROUP BY id""",
        "prompts",
    ),
)
def best_match_per_id_query(spark: SparkSession, sf: str) -> DataFrame:
    matches = prompt_matches(relation(spark, sf, "prompts"), query_vector(spark, sf))
    best = best_match_per_id(matches).select("id", "gcs_video_path", "prompt_text", "best_distance")
    return rounded(best, "best_distance")


_PROMPT_TOP = f"""SELECT id, any_value(gcs_video_path) AS gcs_video_path, any_value(prompt_text) AS prompt_text,
  any_value(created_at) AS created_at, min(distance) AS best_distance
  FROM ({_CANDIDATES}) GROUP BY id ORDER BY best_distance, id LIMIT 3"""
_PROMPT_CHECK = check_sql(
    f"""SELECT id, gcs_video_path, prompt_text, {_CREATED}, round(best_distance, 6) + 0 AS best_distance,
    '{_HOST}' || replace(gcs_video_path, 'gs://', '') AS video_url FROM ({_PROMPT_TOP})""",
    "prompts",
)


def _prompts_shown(found: DataFrame) -> DataFrame:
    return rounded(found, "best_distance").select(
        "id", "gcs_video_path", "prompt_text", _created(), "best_distance", "video_url"
    )


@query("prompt_search", _PROMPT_CHECK)
def prompt_search_query(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts_shown(prompt_search(relation(spark, sf, "prompts"), query_vector(spark, sf)))


@query("prompt_search_single_pass", _PROMPT_CHECK)
def prompt_search_single_pass_query(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts_shown(prompt_search_single_pass(relation(spark, sf, "prompts"), query_vector(spark, sf)))


@query(
    "prompt_search_score",
    check_sql(
        f"SELECT id, round(1 - (1 - {_cosine('video_embedding', _Q)}), 3) + 0 AS score FROM prompts",
        "prompts",
    ),
)
def prompt_search_score_query(spark: SparkSession, sf: str) -> DataFrame:
    prompts = relation(spark, sf, "prompts")
    distance = distance_to(F.col("video_embedding"), query_vector(spark, sf))
    return prompts.select("id", prompt_search_score(distance).alias("score"))


_INDEXES: dict[tuple[str, ...], str] = {}


def forget_indexes() -> None:
    """The next query that needs a clustered table builds it anew."""
    _INDEXES.clear()


def index_of(spark: SparkSession, sf: str, name: str = "scenes", vec_col: str = "embedding") -> str:
    """Folder of a relation as a clustered table, built once per application."""
    at = (spark.sparkContext.applicationId, sf, name, vec_col)
    if at not in _INDEXES:
        path = work_folder(spark, "cells")
        ivf.ivf_build(relation(spark, sf, name, heavy=True), path, vec_col)
        _INDEXES[at] = path
    return _INDEXES[at]


@query(
    "ivf_build",
    check_sql(
        """SELECT title, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) + 0 AS norm,
        1 AS times_stored FROM scenes WHERE len(embedding) > 0""",
        "scenes",
    ),
)
def ivf_build_query(spark: SparkSession, sf: str) -> DataFrame:
    stored = ivf.ivf_rows(spark, index_of(spark, sf))
    counted = stored.groupBy("title").agg(F.round(F.max("norm"), 6).alias("norm"), F.count("*").alias("times_stored"))
    return counted.withColumn("times_stored", F.col("times_stored").cast("int"))


@query(
    "ivf_cells",
    check_sql("SELECT count(*) AS n_rows, 1.0::DOUBLE AS share, true AS several FROM scenes WHERE len(embedding) > 0", "scenes"),
)
def ivf_cells_query(spark: SparkSession, sf: str) -> DataFrame:
    """The cells hold all rows with a vector, and their shares add up to one."""
    cells = ivf.ivf_cells(spark, index_of(spark, sf))
    return cells.agg(
        F.sum("n_rows").alias("n_rows"), F.round(F.sum("share"), 6).alias("share"), (F.count("*") > 1).alias("several")
    )


# More than any table here has cells.
_ALL_CELLS = 1 << 20


@query("ivf_search", _COSINE_SEARCH)
def ivf_search_query(spark: SparkSession, sf: str) -> DataFrame:
    """Probing every cell, which has to give the exact result."""
    found = ivf.ivf_search(spark, index_of(spark, sf), query_vector(spark, sf), nprobe=_ALL_CELLS, bucket="bucket")
    return scenes_found(found)


@query(
    "ivf_search_probed",
    check_sql("SELECT 5 AS n_found, true AS distances_are_true, true AS none_nearer_than_the_first", "scenes"),
)
def ivf_search_probed(spark: SparkSession, sf: str) -> DataFrame:
    """The scenes found in as many cells as the build has measured, held against the distances of all scenes by column expressions."""
    found = ivf.ivf_search(spark, index_of(spark, sf), query_vector(spark, sf)).select("title", "distance")
    scenes = relation(spark, sf, "scenes").select("title", distance_to(F.col("embedding"), query_vector(spark, sf)).alias("true_distance"))
    least = scenes.agg(F.min("true_distance")).scalar()
    joined = found.join(scenes, "title")
    return joined.agg(
        F.count("*").cast("int").alias("n_found"),
        F.bool_and(F.abs(F.col("distance") - F.col("true_distance")) < 1e-9).alias("distances_are_true"),
        F.bool_and(F.col("distance") >= least - 1e-9).alias("none_nearer_than_the_first"),
    )


@query("ivf_search_batch", _join_check("1 - " + _cosine("s.embedding", "q.query_embedding"), _NARROW))
def ivf_search_batch_query(spark: SparkSession, sf: str) -> DataFrame:
    """Probing every cell, which has to give the exact result."""
    vectors = relation(spark, sf, "query_vectors")
    found = ivf.ivf_search_batch(spark, index_of(spark, sf), vectors, nprobe=_ALL_CELLS, key=["title"])
    return rounded(found.select("query_id", "rank", "video_id", "timestamp_start", "title", "distance"), "distance")


# What the cells that the build has measured find of the exact neighbours on average, at least.
_RECALL_FLOOR = 0.9


@query("ivf_recall", "SELECT vec_id AS query_id, true AS is_share, true AS floor_met FROM embeddings")
def ivf_recall_query(spark: SparkSession, sf: str) -> DataFrame:
    """The recall of each query is a share, and their mean reaches the floor, on distinct vectors without the query's own."""
    scenes, vectors = relation(spark, sf, "scenes", heavy=True), relation(spark, sf, "query_vectors")
    folder = work_folder(spark, "distinct")
    narrow = scenes.select("video_id", "timestamp_start", "title", "embedding").filter(F.size("embedding") > 0)
    narrow.dropDuplicates(["embedding"]).write.parquet(f"{folder}/rows")
    distinct = spark.read.parquet(f"{folder}/rows")
    ivf.ivf_build(distinct, f"{folder}/cells")
    exact = knn_join(distinct, vectors, k=6).filter("distance > 1e-9")
    found = ivf.ivf_search_batch(spark, f"{folder}/cells", vectors, k=6)
    recall = ivf.ivf_recall(exact, found, ["title"])
    mean = recall.agg(F.avg("recall").alias("mean"))
    shares = recall.select("query_id", F.col("recall").between(0, 1).alias("is_share"))
    return shares.withColumn("floor_met", mean.scalar() >= _RECALL_FLOOR)


@query("ivf_prompt_search", _PROMPT_CHECK)
def ivf_prompt_search_query(spark: SparkSession, sf: str) -> DataFrame:
    """Probing every cell of both clustered tables, which has to give the exact result."""
    by_video, by_text = (index_of(spark, sf, "prompts", c) for c in PROMPT_VECTORS)
    return _prompts_shown(ivf.ivf_prompt_search(spark, by_video, by_text, query_vector(spark, sf), nprobe=_ALL_CELLS))


@query(
    "ivf_append",
    check_sql("SELECT video_id, count(*) AS n_scenes, count(DISTINCT title) AS n_titles FROM scenes GROUP BY video_id", "scenes"),
)
def ivf_append_query(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster the hosted scenes, add the others to the same cells, and read everything back."""
    scenes = relation(spark, sf, "scenes")
    hosted = F.coalesce(F.col("source").startswith("http"), F.lit(False))
    path = work_folder(spark, "cells")
    ivf.ivf_build(scenes.filter(hosted), path, nlist=16)
    ivf.ivf_append(scenes.filter(~hosted), path)
    counted = ivf.ivf_rows(spark, path).groupBy("video_id")
    return counted.agg(F.count("*").alias("n_scenes"), F.countDistinct("title").alias("n_titles"))


_BATCH_BRANCH = """SELECT query_id, id, gcs_video_path, prompt_text, d FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS r FROM (
    SELECT p.*, q.query_id, 1 - {cosine} AS d FROM prompts p, query_vectors q)) WHERE r <= 3"""
_BATCH = " UNION ALL ".join(
    _BATCH_BRANCH.format(cosine=_cosine(f"p.{c}", "q.query_embedding")) for c in PROMPT_VECTORS
)


@query(
    "prompt_search_batch",
    check_sql(
        f"""SELECT query_id, rank, id, prompt_text, round(d, 6) + 0 AS best_distance,
        '{_HOST}' || replace(gcs_video_path, 'gs://', '') AS video_url FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM (
            SELECT query_id, id, any_value(gcs_video_path) AS gcs_video_path,
              any_value(prompt_text) AS prompt_text, min(d) AS d FROM ({_BATCH}) GROUP BY 1, 2))
        WHERE rank <= 3""",
        "prompts",
        "query_vectors",
    ),
)
def prompt_search_batch_query(spark: SparkSession, sf: str) -> DataFrame:
    return prompts_found(prompt_search_batch(relation(spark, sf, "prompts", heavy=True), relation(spark, sf, "query_vectors")))


def prompts_found(found: DataFrame) -> DataFrame:
    return rounded(found, "best_distance").select("query_id", "rank", "id", "prompt_text", "best_distance", "video_url")
