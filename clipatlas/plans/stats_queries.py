"""Dashboard figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.operators import stats
from clipatlas.plans.registry import query
from clipatlas.plans.relations import check_sql, relation


def _whole_sql(part: str) -> str:
    """A whole number of any length, in a wide integer."""
    bare = f"regexp_replace({part}, '^[\\s\\x{{a0}}\\x{{3000}}]+|[\\s\\x{{a0}}\\x{{3000}}]+$', '', 'g')"
    return f"CASE WHEN regexp_full_match({bare}, '[+-]?[0-9]+(_[0-9]+)*') THEN TRY_CAST(replace({bare}, '_', '') AS HUGEINT) END"


def seconds_sql(c: str) -> str:
    p = [_whole_sql(f"string_split({c}, ':')[{i}]") for i in (1, 2, 3)]
    n = f"len(string_split({c}, ':'))"
    return (
        f"CAST(coalesce(CASE WHEN {n} = 2 THEN ({p[0]}) * 60 + ({p[1]}) "
        f"WHEN {n} = 3 THEN ({p[0]}) * 3600 + ({p[1]}) * 60 + ({p[2]}) ELSE {p[0]} END, 0) AS BIGINT)"
    )


DURATION_SQL = f"greatest(0, {seconds_sql('timestamp_end')} - {seconds_sql('timestamp_start')})"
CLASS_SQL = """CASE WHEN lower(coalesce(source, '')) LIKE 'http%' OR lower(coalesce(source, '')) LIKE '%youtube%'
  THEN 'YouTube' WHEN lower(source) LIKE 'gs://%' OR lower(source) = 'gcs' THEN 'GCS' ELSE 'Local' END"""
_CATEGORY = "SELECT category, count(*) AS n FROM scenes WHERE category <> '' GROUP BY category"
_SOURCE = f"""SELECT {CLASS_SQL} AS source_class, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT source, count(DISTINCT video_id) AS n FROM scenes GROUP BY source) GROUP BY 1"""
_TAGS = """SELECT tag, count(*) AS n FROM (
  SELECT regexp_replace(unnest(string_split(tags, ',')), '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g') AS tag FROM scenes
  WHERE tags <> '') WHERE tag <> '' GROUP BY tag"""
_TOP = f"SELECT * FROM ({_TAGS}) ORDER BY n DESC, tag LIMIT 10"
_AVERAGE = """CASE WHEN count(*) > 0 THEN round_even(count(*) / count(DISTINCT video_id), 1) ELSE 0 END"""
_SECONDS = f"CAST(coalesce(sum({DURATION_SQL}), 0) AS BIGINT)"
_MEAN = f"CASE WHEN count(*) > 0 THEN round_even({_SECONDS} / count(*), 0) ELSE 0 END"


def _of_scenes(body: str) -> str:
    return check_sql(body, "scenes")


@query("total_assets", _of_scenes("SELECT count(DISTINCT video_id) AS total_assets FROM scenes"))
def total_assets(spark: SparkSession, sf: str) -> DataFrame:
    return stats.total_assets(relation(spark, sf, "scenes"))


@query("total_scenes", _of_scenes("SELECT count(*) AS total_scenes FROM scenes"))
def total_scenes(spark: SparkSession, sf: str) -> DataFrame:
    return stats.total_scenes(relation(spark, sf, "scenes"))


@query("avg_scenes_per_asset", _of_scenes(f"SELECT {_AVERAGE} AS average_scenes_per_asset FROM scenes"))
def avg_scenes_per_asset(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scene_totals(relation(spark, sf, "scenes")).select("average_scenes_per_asset")


@query("category_breakdown", _of_scenes(_CATEGORY))
def category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return stats.category_breakdown(relation(spark, sf, "scenes"))


@query("source_breakdown", _of_scenes(_SOURCE))
def source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return stats.source_breakdown(relation(spark, sf, "scenes"))


@query("total_duration", _of_scenes(f"SELECT {_SECONDS} AS total_duration_seconds FROM scenes"))
def total_duration(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scene_totals(relation(spark, sf, "scenes")).select(F.col("total_duration_seconds").cast("bigint").alias("total_duration_seconds"))


@query("avg_scene_duration", _of_scenes(f"SELECT CAST({_MEAN} AS BIGINT) AS avg_scene_duration_seconds FROM scenes"))
def avg_scene_duration(spark: SparkSession, sf: str) -> DataFrame:
    return stats.scene_totals(relation(spark, sf, "scenes")).select(F.col("avg_scene_duration_seconds").cast("bigint").alias("avg_scene_duration_seconds"))


@query("tag_frequency", _of_scenes(_TAGS))
def tag_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.tag_frequency(relation(spark, sf, "scenes"))


@query("top_tags", _of_scenes(_TOP))
def top_tags(spark: SparkSession, sf: str) -> DataFrame:
    return stats.top_tags(relation(spark, sf, "scenes"))


@query("total_prompt_videos", check_sql("SELECT count(*) AS total_prompt_videos FROM prompts", "prompts"))
def total_prompt_videos(spark: SparkSession, sf: str) -> DataFrame:
    return stats.total_prompt_videos(relation(spark, sf, "prompts"))


@query(
    "breakdown_percent",
    _of_scenes(
        f"""SELECT category, n, round(n / (SELECT greatest(max(n), 1) FROM ({_CATEGORY})) * 100, 6) AS percent
        FROM ({_CATEGORY})"""
    ),
)
def breakdown_percent(spark: SparkSession, sf: str) -> DataFrame:
    shares = stats.breakdown_percent(stats.category_breakdown(relation(spark, sf, "scenes")))
    return shares.withColumn("percent", F.round("percent", 6))


_FIGURES = {
    "total_assets": "count(DISTINCT video_id)",
    "total_scenes": "count(*)",
    "average_scenes_per_asset": _AVERAGE,
    "total_duration_seconds": _SECONDS,
    "avg_scene_duration_seconds": _MEAN,
}
_LONG = " UNION ALL ".join(
    [f"SELECT '{m}' AS metric, '' AS key, CAST({e} AS DOUBLE) AS value FROM scenes" for m, e in _FIGURES.items()]
    + ["SELECT 'total_prompt_videos', '', CAST(count(*) AS DOUBLE) FROM prompts"]
    + [
        f"SELECT '{metric}', {key}, CAST(n AS DOUBLE) FROM ({body})"
        for metric, key, body in (
            ("category_breakdown", "category", _CATEGORY),
            ("source_breakdown", "source_class", _SOURCE),
            ("top_tags", "tag", _TOP),
        )
    ]
)


@query("stats", check_sql(_LONG, "scenes", "prompts"))
def stats_long(spark: SparkSession, sf: str) -> DataFrame:
    return stats.stats(relation(spark, sf, "scenes"), relation(spark, sf, "prompts"))


@query(
    "stats_document",
    check_sql(
        f"""SELECT {', '.join(f'CAST({e} AS DOUBLE) AS {m}' for m, e in _FIGURES.items())},
        (SELECT string_agg(source_class || '=' || n, '|' ORDER BY source_class) FROM ({_SOURCE})) AS source_breakdown,
        (SELECT string_agg(tag || '=' || n, '|' ORDER BY tag) FROM ({_TOP})) AS top_tags,
        (SELECT CAST(count(*) AS DOUBLE) FROM prompts) AS total_prompt_videos FROM scenes""",
        "scenes",
        "prompts",
    ),
)
def stats_document(spark: SparkSession, sf: str) -> DataFrame:
    document = stats.stats_document(stats_long(spark, sf))

    def shown(name: str) -> F.Column:
        entries = F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
        return F.array_join(F.sort_array(entries), "|").alias(name)

    maps = ("source_breakdown", "top_tags")
    return document.select(
        *[shown(c) if c in maps else F.col(c).cast("double").alias(c) for c in document.columns]
    )
