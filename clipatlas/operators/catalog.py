"""Listing assets and their scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipatlas.functions.labels import NO_SUMMARY, UNTITLED, nonempty, or_default, scene_details, tags_split
from clipatlas.functions.links import scene_video_url
from clipatlas.functions.timecodes import timestamp_seconds
from clipatlas.schemas import SCENE_TEXT_COLUMNS


def asset_detail(scenes: DataFrame, video_id: str, bucket: str | None = None) -> DataFrame:
    """All scenes of one video in playing order, with split tags and the video address."""
    order = [timestamp_seconds(F.col("timestamp_start")), timestamp_seconds(F.col("timestamp_end")), F.col("title")]
    return (
        scenes.filter(F.col("video_id") == video_id)
        .orderBy(*order)
        .select(
            *[tags_split(F.col(c)).alias(c) if c == "tags" else c for c in SCENE_TEXT_COLUMNS],
            scene_video_url(F.col("source"), F.col("video_id"), bucket).alias("video_url"),
        )
    )


def list_assets(scenes: DataFrame) -> DataFrame:
    """One row per video and summary with the set of its tags.

    Tags are split at commas only, so blanks matter and '' can be a tag. An asset whose tag texts,
    joined with commas, are missing or '' has no tags. Equal tag texts are counted before they are
    split and equal tags before they are gathered, so an asset of any number of scenes reaches one
    task only as its distinct tags.
    """
    texts = scenes.groupBy("video_id", "summary", "tags").agg(F.count("*").alias("n"))
    parts = texts.select("video_id", "summary", "n", F.explode_outer(F.split("tags", ",")).alias("tag"))
    tags = parts.groupBy("video_id", "summary", "tag").agg(F.sum("n").alias("n"))
    assets = tags.groupBy("video_id", "summary").agg(
        F.sort_array(F.collect_list("tag")).alias("tags"),
        F.sum(F.when(F.col("tag").isNotNull(), F.col("n"))).alias("n"),
    )
    lone_blank = (F.size("tags") == 1) & (F.get("tags", F.lit(0)) == "") & (F.col("n") == 1)
    return assets.select(
        "video_id",
        "summary",
        F.when(lone_blank, F.array().cast("array<string>")).otherwise(F.col("tags")).alias("tags"),
    )


def first_scene(scenes: DataFrame) -> DataFrame:
    """The earliest scene of every video, whose address the player opens."""
    start, end = timestamp_seconds(F.col("timestamp_start")), timestamp_seconds(F.col("timestamp_end"))
    order = F.struct(start, end, "title")
    shown = F.struct("title", "timestamp_start", "timestamp_end", "source")
    first = scenes.groupBy("video_id").agg(F.min_by(shown, order).alias("first"))
    return first.select("video_id", "first.*")


def with_display_defaults(scenes: DataFrame) -> DataFrame:
    return scenes.withColumns(
        {
            "title": or_default(F.col("title"), UNTITLED),
            "summary": or_default(F.col("summary"), NO_SUMMARY),
        }
    )


def scene_notes(scenes: DataFrame, *keep: str) -> DataFrame:
    """One row per note of a scene that is not empty: ``label, note``."""
    return scenes.select(*keep, F.explode(scene_details()).alias("label", "note"))


def with_category(scenes: DataFrame) -> DataFrame:
    return scenes.filter(nonempty(F.col("category")))


def with_tags(scenes: DataFrame) -> DataFrame:
    return scenes.filter(nonempty(F.col("tags")))
