"""Scene, prompt and request relations derived from the given tables.

Each text is run unchanged by Spark and, as a CTE, by DuckDB. Braces name the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.schemas import RESPONSE_SCENE_FIELDS
from clipatlas.sources.tables import append_scenes
from clipatlas.workdir import settings, work_folder

# One row per event; every vector of the table is that of some scene. The title is unique: twelve digits hold
# any event id.
SCENES_SQL = """
SELECT 'vid_' || cast(e.user_id AS string) || '.mp4' AS video_id,
  CASE WHEN e.event_id % 59 = 0 THEN NULL WHEN e.event_id % 53 = 0 THEN 'local'
       WHEN e.user_id % 5 = 0 THEN 'gs://bucket/vid_' || cast(e.user_id AS string) || '.mp4'
       WHEN e.user_id % 5 = 1 THEN 'https://www.youtube.com/watch?v=v' || cast(e.user_id AS string) || '&t=1'
       WHEN e.user_id % 5 = 2 THEN 'gcs'
       WHEN e.user_id % 5 = 3 THEN 'https://youtu.be/y' || cast(e.user_id AS string)
       ELSE 'local' END AS source,
  CASE WHEN e.event_id % 97 = 0 THEN '' WHEN e.event_id % 89 = 0 THEN 'xx:10' WHEN e.event_id % 83 = 0 THEN '1.5:10'
       WHEN e.event_id % 4000 >= 3600 THEN '1:' || lpad(cast(cast(floor((e.event_id % 4000 - 3600) / 60) AS int) AS string), 2, '0') || ':' || lpad(cast(e.event_id % 4000 % 60 AS string), 2, '0')
       ELSE lpad(cast(cast(floor(e.event_id % 4000 / 60) AS int) AS string), 2, '0') || ':' || lpad(cast(e.event_id % 4000 % 60 AS string), 2, '0') END AS timestamp_start,
  lpad(cast(cast(floor((e.event_id % 4000 + e.event_id * 13 % 45 + 56) / 60) AS int) - 1 AS string), 2, '0') || ':' || lpad(cast((e.event_id % 4000 + e.event_id * 13 % 45 + 56) % 60 AS string), 2, '0') AS timestamp_end,
  'scene ' || lpad(cast(e.event_id AS string), 12, '0') AS title,
  CASE WHEN e.event_id % 41 = 0 THEN NULL WHEN e.event_id % 43 = 0 THEN '' ELSE e.event_type END AS category,
  e.event_type || ' by user ' || cast(e.user_id AS string) AS description,
  CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE 'why ' || e.event_type END AS editing_justification,
  CASE WHEN e.event_id % 4 = 0 THEN '' ELSE 'pan' END AS visuals_camera,
  CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE 'voice' END AS audio_cues,
  'fast' AS pacing,
  CASE WHEN e.event_id % 6 = 0 THEN '' ELSE 'shorts' END AS repurposing_idea,
  CASE WHEN e.event_id % 7 = 0 THEN NULL ELSE 'trim' END AS edit_cut_notes,
  CASE WHEN e.user_id % 11 = 0 AND e.event_id % 2 = 0 THEN 'second summary of vid_' || cast(e.user_id AS string)
       ELSE 'summary of vid_' || cast(e.user_id AS string) END AS summary,
  CASE WHEN e.event_id % 31 = 0 THEN NULL WHEN e.event_id % 37 = 0 THEN ''
       ELSE e.event_type || ', k' || cast(e.event_id % 7 AS string) || ',u' || cast(e.user_id % 5 AS string) || ',' END AS tags,
  m.embedding AS embedding
FROM (SELECT *, event_id % (SELECT count(*) FROM {embeddings}) AS vec_no FROM {events}) e
JOIN {embeddings} m ON m.vec_id = e.vec_no
"""

PROMPTS_SQL = """
SELECT 'p' || lpad(cast(a.vec_id AS string), 12, '0') AS id,
  'gs://bucket/genAI_videos/' || cast(a.vec_id AS string) || '.mp4' AS gcs_video_path,
  'prompt ' || cast(a.vec_id AS string) AS prompt_text,
  a.embedding AS video_embedding, b.embedding AS prompt_embedding, e.ts AS created_at
FROM (SELECT *, (vec_id * 7 + 3) % (SELECT count(*) FROM {embeddings}) AS other_no FROM {embeddings}) a
JOIN {embeddings} b ON b.vec_id = a.other_no
JOIN {events} e ON e.event_id = a.vec_id
"""

REQUESTS_SQL = """
SELECT page_id AS request_id,
  CASE WHEN page_id % 5 IN (0, 1) THEN 'gs://bucket/in/clip_' || cast(page_id AS string) || '.mp4' END AS gcs_uri,
  CASE WHEN page_id % 5 IN (1, 2, 3) THEN url END AS youtube_url
FROM {pages}
"""

SEARCH_REQUESTS_SQL = """
SELECT conv_id * 1000 + turn AS request_id,
  CASE WHEN turn % 3 = 1 THEN NULL ELSE text END AS query_text,
  CASE WHEN turn % 3 = 1 AND conv_id % 4 = 0 THEN 'data:image/png' WHEN turn % 3 = 1 AND conv_id % 4 = 1 THEN ''
       WHEN turn % 3 = 1 THEN 'data:image/png;base64,aGVsbG8=' END AS query_image
FROM {conversations}
"""

# Every vector of the table is a query.
QUERY_VECTORS_SQL = "SELECT vec_id AS query_id, embedding AS query_embedding FROM {embeddings}"

RELATIONS = {
    "scenes": SCENES_SQL,
    "prompts": PROMPTS_SQL,
    "requests": REQUESTS_SQL,
    "search_requests": SEARCH_REQUESTS_SQL,
    "query_vectors": QUERY_VECTORS_SQL,
}
_TABLES = ("events", "embeddings", "pages", "conversations", "documents")
_VECTORS = ("embedding", "video_embedding", "prompt_embedding", "query_embedding")

# For the checks only: the documents that ``responses`` builds, from the scenes.
_DOCUMENTS_SQL = """
SELECT video_id, summary, substr(title, 1, length(title) - 2) AS hundred,
  count(*) AS n_scenes, min(coalesce(source, 'local')) AS source, arg_min(coalesce(tags, ''), title) AS tags,
  CAST(right(min(title), 2) AS INT) % 16 AS kind
FROM scenes GROUP BY 1, 2, 3
"""

# The vector and the video that the single searches ask for.
QUERY_VEC_ID = 7
VIDEO_ID = "vid_3.mp4"


def check_sql(body: str, *relations: str) -> str:
    """DuckDB text of ``body`` with the named relations in front."""
    names = {t: t for t in _TABLES}
    texts = {**RELATIONS, "documents_of": _DOCUMENTS_SQL}
    ctes = ", ".join(f"{r} AS ({texts[r].format(**names)})" for r in relations)
    return f"WITH {ctes} {body}" if ctes else body


_READ: dict[tuple[str, ...], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. The schema is read from the files once per application; the rows are not kept."""
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _READ:
        _READ[at] = spark.read.parquet(f"{sf}/{name}.parquet")
    return _READ[at]


_SPLITS: dict[tuple[str, ...], int] = {}


def spread(df: DataFrame, *at: str, tasks: int = 0) -> DataFrame:
    """Rows of a given table that Spark reads in fewer tasks than there are cores, or ``tasks``, dealt out to all of them.

    For work that takes long per row. Files are split by bytes, but a row group is read whole by one task and the other
    splits of it are empty, so only tasks that get rows count. They are counted once per table, without reading a column.
    """
    wanted = max(tasks, df.sparkSession.sparkContext.defaultParallelism)
    if at not in _SPLITS:
        _SPLITS[at] = df.select(F.spark_partition_id().alias("task")).distinct().count()
    return df.repartition(wanted) if _SPLITS[at] < wanted else df


def relation(spark: SparkSession, sf: str, name: str, heavy: bool = False, tasks: int = 0) -> DataFrame:
    """A derived relation. ``heavy`` announces work that takes long per row, for so many tasks at least."""
    text = RELATIONS[name]
    used = {t: table(spark, sf, t) for t in _TABLES if "{" + t + "}" in text}
    if heavy:
        used = {t: spread(df, spark.sparkContext.applicationId, sf, t, tasks=tasks) for t, df in used.items()}
    df = spark.sql(text, **used)
    for c in _VECTORS:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("array<double>"))
    return df


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").filter(F.col("vec_id") == QUERY_VEC_ID).first()
    return [float(x) for x in row.embedding]


_STORED: dict[tuple[str, str], str] = {}


# Scenes that a task sorts at most while they are stored; a scene has a kilobyte or more.
STORED_ROWS = 200_000


def stored_scenes(spark: SparkSession, sf: str) -> str:
    """Folder of the scenes written as a table, once per application.

    Scenes become wide when events meet their vectors, so they are not shuffled after that; a task sorts its own. The
    number of tasks follows from the rows, since what the join reads is a small part of what it gives.
    """
    at = (spark.sparkContext.applicationId, sf)
    if at not in _STORED:
        path = work_folder(spark, "scenes")
        tasks = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "events").count() // STORED_ROWS))
        with settings(spark, shuffle__partitions=str(tasks), adaptive__coalescePartitions__enabled="false"):
            append_scenes(relation(spark, sf, "scenes", heavy=True, tasks=tasks), path, required=())
        _STORED[at] = path
    return _STORED[at]


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """The scenes written back as model responses, one per video, summary and hundred event ids.

    The number of scenes in a document is bounded, however many a video has. Six kinds in sixteen
    are damaged: cut off, without summary, with text for scenes, with a scene that has no title,
    with words after the document, and with a number for the summary.
    """
    fields = {"start_timestamp": "timestamp_start", "end_timestamp": "timestamp_end"}
    scene = F.struct(
        *[F.coalesce(F.col(fields.get(f, f)), F.lit("")).alias(f) for f in RESPONSE_SCENE_FIELDS]
    )
    documents = (
        relation(spark, sf, "scenes", heavy=True)
        .withColumn("hundred", F.expr("substring(title, 1, length(title) - 2)"))
        .groupBy("video_id", "summary", "hundred")
        .agg(
            F.sort_array(F.collect_list(scene)).alias("scenes"),
            F.min(F.coalesce("source", F.lit("local"))).alias("source"),
            F.split(F.min_by(F.coalesce("tags", F.lit("")), "title"), ",").alias("tags"),
            (F.expr("cast(right(min(title), 2) AS int)") % 16).alias("kind"),
        )
    )
    whole = F.to_json(F.struct("summary", "tags", "scenes"))
    untitled = F.transform(
        "scenes", lambda s, i: F.when(i == 0, s.withField("title", F.lit(None).cast("string"))).otherwise(s)
    )
    kind = F.col("kind")
    text = (
        F.when(kind == 0, F.substring(whole, F.lit(1), F.length(whole) - 1))
        .when(kind == 1, F.to_json(F.struct("tags", "scenes")))
        .when(kind == 2, F.to_json(F.struct("summary", "tags", F.lit("none").alias("scenes"))))
        .when(kind == 3, F.to_json(F.struct("summary", "tags", untitled.alias("scenes"))))
        .when(kind == 4, F.concat(whole, F.lit(" and that was all")))
        .when(kind == 5, F.to_json(F.struct(F.lit(5).alias("summary"), "tags", "scenes")))
        .otherwise(whole)
    )
    return documents.select(
        F.concat_ws("#", "video_id", "summary", "hundred").alias("response_id"),
        "video_id",
        "source",
        text.alias("response"),
    )
