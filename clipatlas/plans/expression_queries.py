"""Scalar expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.functions import labels, links, timecodes
from clipatlas.plans.registry import query
from clipatlas.plans.relations import check_sql, relation, table
from clipatlas.plans.search_queries import _HOST, _URL
from clipatlas.plans.stats_queries import CLASS_SQL, DURATION_SQL, seconds_sql


def _of_scenes(columns: str) -> str:
    return check_sql(f"SELECT title, {columns} FROM scenes", "scenes")


def _number_sql(part: str) -> str:
    return (
        f"CASE WHEN trim({part}) = '' THEN 0.0::DOUBLE WHEN regexp_full_match({part}, "
        "'\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') "
        f"THEN CAST(trim({part}) AS DOUBLE) END"
    )


def _lenient_sql(c: str) -> str:
    p = [_number_sql(f"string_split({c}, ':')[{i}]") for i in (1, 2, 3)]
    n = f"len(string_split({c}, ':'))"
    return (
        f"CASE WHEN coalesce({c}, '') = '' THEN 0.0::DOUBLE WHEN {n} = 2 THEN ({p[0]}) * 60 + ({p[1]}) "
        f"WHEN {n} = 3 THEN ({p[0]}) * 3600 + ({p[1]}) * 60 + ({p[2]}) ELSE coalesce({p[0]}, 0) END"
    )


def _seconds_text_sql(c: str) -> str:
    s = _lenient_sql(c)
    return (
        f"CASE WHEN ({s}) IS NULL THEN 'NaN' WHEN ({s}) = floor({s}) "
        f"THEN CAST(CAST(({s}) AS BIGINT) AS VARCHAR) ELSE CAST(({s}) AS VARCHAR) END"
    )


def _embed_sql(url: str, start: str) -> str:
    video = f"""CASE WHEN {url} LIKE '%youtube.com%' THEN regexp_extract({url}, '[?&]v=([^&#]*)', 1)
      WHEN {url} LIKE '%youtu.be%' THEN regexp_extract({url}, 'youtu[.]be/([^/?#]*)', 1)
      WHEN {url} NOT LIKE '%/%' THEN {url} ELSE '' END"""
    return f"""CASE WHEN coalesce({video}, '') = '' THEN ''
      ELSE 'https://www.youtube.com/embed/' || ({video}) || '?start=' || {_seconds_text_sql(start)} END"""


@query("timestamp_seconds", _of_scenes(f"{seconds_sql('timestamp_start')} AS s, {seconds_sql('timestamp_end')} AS e"))
def timestamp_seconds(spark: SparkSession, sf: str) -> DataFrame:
    start, end = (timecodes.timestamp_seconds(F.col(c)).cast("bigint") for c in ("timestamp_start", "timestamp_end"))
    return relation(spark, sf, "scenes").select("title", start.alias("s"), end.alias("e"))


@query("timestamp_seconds_lenient", _of_scenes(f"{_lenient_sql('timestamp_start')} AS s"))
def timestamp_seconds_lenient(spark: SparkSession, sf: str) -> DataFrame:
    start = timecodes.timestamp_seconds_lenient(F.col("timestamp_start"))
    return relation(spark, sf, "scenes").select("title", start.alias("s"))


@query("scene_duration", _of_scenes(f"{DURATION_SQL} AS seconds"))
def scene_duration(spark: SparkSession, sf: str) -> DataFrame:
    length = timecodes.scene_duration(F.col("timestamp_start"), F.col("timestamp_end"))
    return relation(spark, sf, "scenes").select("title", length.cast("bigint").alias("seconds"))


_CLOCK = """CASE WHEN {s} >= 3600 THEN CAST({s} // 3600 AS VARCHAR) || 'h ' ELSE '' END ||
  CASE WHEN {s} >= 60 THEN CAST({s} % 3600 // 60 AS VARCHAR) || 'm ' ELSE '' END || CAST({s} % 60 AS VARCHAR) || 's'"""


@query(
    "format_duration",
    check_sql(
        f"""SELECT video_id, {_CLOCK.format(s='total')} AS total_text FROM (
        SELECT video_id, CAST(sum({DURATION_SQL}) AS BIGINT) AS total FROM scenes GROUP BY video_id)""",
        "scenes",
    ),
)
def format_duration(spark: SparkSession, sf: str) -> DataFrame:
    length = timecodes.scene_duration(F.col("timestamp_start"), F.col("timestamp_end"))
    totals = relation(spark, sf, "scenes").groupBy("video_id").agg(F.sum(length).alias("total"))
    return totals.select("video_id", timecodes.format_duration(F.col("total")).alias("total_text"))


@query("source_class", _of_scenes(f"{CLASS_SQL} AS source_class"))
def source_class(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "scenes").select("title", links.source_class(F.col("source")).alias("source_class"))


@query("scene_video_url", _of_scenes(f"{_URL} AS video_url, coalesce(CASE WHEN source = 'gcs' THEN 'gcs' ELSE {_URL} END, '') AS bare_url"))
def scene_video_url(spark: SparkSession, sf: str) -> DataFrame:
    source, video = F.col("source"), F.col("video_id")
    return relation(spark, sf, "scenes").select(
        "title",
        links.scene_video_url(source, video, "bucket").alias("video_url"),
        links.scene_video_url(source, video).alias("bare_url"),
    )


@query(
    "prompt_video_url",
    check_sql(
        f"""SELECT id, '{_HOST}' || replace(gcs_video_path, 'gs://', '') AS video_url,
        '' AS other_url FROM prompts""",
        "prompts",
    ),
)
def prompt_video_url(spark: SparkSession, sf: str) -> DataFrame:
    return relation(spark, sf, "prompts").select(
        "id",
        links.prompt_video_url(F.col("gcs_video_path")).alias("video_url"),
        links.prompt_video_url(F.col("prompt_text")).alias("other_url"),
    )


@query("youtube_embed_url", _of_scenes(f"{_embed_sql('source', 'timestamp_start')} AS embed_url"))
def youtube_embed_url(spark: SparkSession, sf: str) -> DataFrame:
    link = links.youtube_embed_url(F.col("source"), F.col("timestamp_start"))
    return relation(spark, sf, "scenes").select("title", link.alias("embed_url"))


@query(
    "playback_url",
    check_sql(
        f"""SELECT title, CASE WHEN url NOT LIKE 'http%' THEN ''
          WHEN url LIKE '%youtube.com%' OR url LIKE '%youtu.be%' THEN {_embed_sql('url', 'timestamp_start')}
          ELSE url || '#t=' || {_seconds_text_sql('timestamp_start')} END AS playback_url
        FROM (SELECT title, timestamp_start, {_URL} AS url FROM scenes)""",
        "scenes",
    ),
)
def playback_url(spark: SparkSession, sf: str) -> DataFrame:
    url = links.scene_video_url(F.col("source"), F.col("video_id"), "bucket")
    link = links.playback_url(url, F.col("video_id"), F.col("timestamp_start"))
    return relation(spark, sf, "scenes").select("title", link.alias("playback_url"))


@query(
    "storage_uris",
    check_sql(
        """SELECT request_id, 'gs://uploads/' || name AS upload_uri, 'gs://uploads/genAI_videos/' || name AS prompt_uri
        FROM (SELECT request_id, 'clip_' || request_id || '.mp4' AS name FROM requests)""",
        "requests",
    ),
)
def storage_uris(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("clip_"), F.col("request_id").cast("string"), F.lit(".mp4"))
    return relation(spark, sf, "requests").select(
        "request_id",
        links.storage_uri("uploads", name).alias("upload_uri"),
        links.storage_uri("uploads", name, links.PROMPT_VIDEO_PREFIX).alias("prompt_uri"),
    )


@query(
    "tags_split",
    _of_scenes(
        """replace(coalesce(tags, ''), ',', '|') AS tags,
        CASE WHEN tags <> '' THEN len(string_split(tags, ',')) ELSE 0 END AS n_tags"""
    ),
)
def tags_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = labels.tags_split(F.col("tags"))
    return relation(spark, sf, "scenes").select(
        "title", F.array_join(parts, "|").alias("tags"), F.size(parts).cast("bigint").alias("n_tags")
    )


@query(
    "tags_clean",
    _of_scenes(
        """array_to_string(list_filter(list_transform(string_split(coalesce(tags, ''), ','),
        lambda t: trim(t)), lambda t: t <> ''), '|') AS tags"""
    ),
)
def tags_clean(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = F.array_join(labels.tags_clean(F.col("tags")), "|")
    return relation(spark, sf, "scenes").select("title", cleaned.alias("tags"))


@query(
    "short_asset_id",
    """SELECT page_id, 'ASSET-' || upper(left(to_hex(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END), 6)) AS short_id
    FROM (SELECT page_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(url, ''),
      lambda c: unicode(c)::BIGINT)), lambda h, u: (h * 31 + u) % 4294967296) AS h FROM pages)""",
)
def short_asset_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", labels.short_asset_id(F.col("url")).alias("short_id"))
