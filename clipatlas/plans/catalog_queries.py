"""Assets, their scenes, and what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.functions.labels import NOTE_LABELS, tags_split
from clipatlas.operators import catalog
from clipatlas.plans.registry import query
from clipatlas.plans.relations import VIDEO_ID, check_sql, relation, stored_scenes
from clipatlas.plans.search_queries import _TEXT, _URL
from clipatlas.plans.stats_queries import seconds_sql
from clipatlas.sources.tables import read_scenes


@query("asset_detail", check_sql(f"SELECT {_TEXT}, {_URL} AS video_url FROM scenes WHERE video_id = '{VIDEO_ID}'", "scenes"))
def asset_detail(spark: SparkSession, sf: str) -> DataFrame:
    scenes = read_scenes(spark, stored_scenes(spark, sf))
    return catalog.asset_detail(scenes, VIDEO_ID, bucket="bucket").withColumn("tags", F.array_join("tags", "|"))


@query(
    "list_assets",
    check_sql(
        """SELECT video_id, summary, array_to_string(parts, '|') AS tags, len(parts) AS n_tags FROM (
          SELECT video_id, summary, CASE WHEN joined IS NULL OR joined = '' THEN []
            ELSE list_sort(list_distinct(string_split(joined, ','))) END AS parts
          FROM (SELECT video_id, summary, string_agg(tags, ',') AS joined FROM scenes GROUP BY 1, 2))""",
        "scenes",
    ),
)
def list_assets(spark: SparkSession, sf: str) -> DataFrame:
    assets = catalog.list_assets(relation(spark, sf, "scenes"))
    return assets.select(
        "video_id",
        "summary",
        F.array_join("tags", "|").alias("tags"),
        F.size("tags").cast("bigint").alias("n_tags"),
    )


@query(
    "first_scene",
    check_sql(
        f"""SELECT video_id, title, timestamp_start, timestamp_end, source FROM (
          SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY {seconds_sql('timestamp_start')},
            {seconds_sql('timestamp_end')}, title) AS r FROM scenes) WHERE r = 1""",
        "scenes",
    ),
)
def first_scene(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_scene(relation(spark, sf, "scenes"))


@query("nonempty_category", check_sql("SELECT title, category FROM scenes WHERE category <> ''", "scenes"))
def nonempty_category(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_category(relation(spark, sf, "scenes")).select("title", "category")


@query("nonempty_tags", check_sql("SELECT title, tags FROM scenes WHERE tags <> ''", "scenes"))
def nonempty_tags(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.with_tags(relation(spark, sf, "scenes")).select("title", "tags")


@query(
    "display_defaults",
    check_sql(
        """SELECT event_no, coalesce(nullif(title, ''), 'Untitled Scene') AS title,
          coalesce(nullif(summary, ''), 'No summary available') AS summary
        FROM (SELECT title AS event_no, category AS title, audio_cues AS summary FROM scenes)""",
        "scenes",
    ),
)
def display_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Shown over two columns that do have gaps."""
    gaps = relation(spark, sf, "scenes").select(
        F.col("title").alias("event_no"), F.col("category").alias("title"), F.col("audio_cues").alias("summary")
    )
    return catalog.with_display_defaults(gaps)


@query(
    "scene_details",
    check_sql(
        " UNION ALL ".join(
            f"SELECT title, '{label}' AS label, {name} AS note FROM scenes WHERE {name} <> ''"
            for label, name in NOTE_LABELS.items()
        ),
        "scenes",
    ),
)
def scene_details(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.scene_notes(relation(spark, sf, "scenes"), "title")


@query(
    "distinct_tags",
    check_sql(
        """SELECT title, array_to_string(list_sort(list_distinct(string_split(tags, ','))), '|') AS tags
        FROM scenes WHERE tags <> ''""",
        "scenes",
    ),
)
def distinct_tags(spark: SparkSession, sf: str) -> DataFrame:
    scenes = catalog.with_tags(relation(spark, sf, "scenes"))
    distinct = F.array_distinct(tags_split(F.col("tags")))
    return scenes.select("title", F.array_join(F.sort_array(distinct), "|").alias("tags"))
