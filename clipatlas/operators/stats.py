"""Figures of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipatlas.functions.labels import nonempty, tags_clean
from clipatlas.functions.links import source_class
from clipatlas.functions.timecodes import SECONDS, scene_duration
from clipatlas.operators.catalog import with_category, with_tags

TOP_TAGS = 10


def _count_of(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias(name))


def total_assets(scenes: DataFrame) -> DataFrame:
    return scenes.agg(F.countDistinct("video_id").alias("total_assets"))


def total_scenes(scenes: DataFrame) -> DataFrame:
    return _count_of(scenes, "total_scenes")


def total_prompt_videos(prompts: DataFrame) -> DataFrame:
    return _count_of(prompts, "total_prompt_videos")


def _ratio(total: Column, n: Column, places: int) -> Column:
    """``total / n`` rounded half to even; 0 when there is nothing to divide by."""
    return F.when(n > 0, F.bround(total / n, places)).otherwise(F.lit(0.0))


def scene_totals(scenes: DataFrame) -> DataFrame:
    """All single figures of the scene table in one pass."""
    totals = scenes.agg(
        F.countDistinct("video_id").alias("total_assets"),
        F.count("*").alias("total_scenes"),
        F.coalesce(
            F.sum(scene_duration(F.col("timestamp_start"), F.col("timestamp_end"))), F.lit(0).cast(SECONDS)
        ).alias("total_duration_seconds"),
    )
    return _with_averages(totals)


def _with_averages(totals: DataFrame) -> DataFrame:
    assets, n, seconds = (F.col(c) for c in ("total_assets", "total_scenes", "total_duration_seconds"))
    return totals.select(
        "*",
        _ratio(n, assets, 1).alias("average_scenes_per_asset"),
        _ratio(seconds.cast("double"), n, 0).cast(SECONDS).alias("avg_scene_duration_seconds"),
    )


def category_breakdown(scenes: DataFrame) -> DataFrame:
    return with_category(scenes).groupBy("category").agg(F.count("*").alias("n"))


def source_breakdown(scenes: DataFrame) -> DataFrame:
    """Videos per source class: distinct per raw source, then added up per class.

    A video with two sources of one class counts twice.
    """
    per_source = scenes.groupBy("source").agg(F.countDistinct("video_id").alias("n"))
    return per_source.groupBy(source_class(F.col("source")).alias("source_class")).agg(F.sum("n").alias("n"))


def tag_frequency(scenes: DataFrame) -> DataFrame:
    """Scenes per tag. Equal tag texts are counted before they are split."""
    texts = with_tags(scenes).groupBy("tags").agg(F.count("*").alias("n"))
    return (
        texts.select("n", F.explode(tags_clean(F.col("tags"))).alias("tag"))
        .groupBy("tag")
        .agg(F.sum("n").alias("n"))
    )


def top_tags(scenes: DataFrame, k: int = TOP_TAGS) -> DataFrame:
    return tag_frequency(scenes).orderBy(F.desc("n"), "tag").limit(k)


def breakdown_percent(breakdown: DataFrame) -> DataFrame:
    """Adds ``percent``: each count as a share of the largest, which counts as 1 at least."""
    largest = breakdown.agg(F.greatest(F.max("n"), F.lit(1))).scalar()
    return breakdown.withColumn("percent", F.col("n") / largest * 100)


# What a batch adds to the figures: scenes and seconds for each source and video, scenes for each category and tag.
FIGURES = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("seconds", T.DecimalType(38, 0)),
    ]
)


def partial_figures(scenes: DataFrame) -> DataFrame:
    """The figures of some scenes in a form that can be added up with those of others, in one grouping."""
    none, no_time = F.lit(None).cast("string"), F.lit(0).cast(SECONDS)

    def entry(kind: str, key: Column, video: Column = none, seconds: Column = no_time) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), video.alias("video_id"), seconds.alias("seconds"))

    duration = scene_duration(F.col("timestamp_start"), F.col("timestamp_end")).cast(SECONDS)
    category = F.when(nonempty(F.col("category")), F.array(entry("category", F.col("category"))))
    tags = F.when(nonempty(F.col("tags")), F.transform(tags_clean(F.col("tags")), lambda tag: entry("tag", tag)))
    nothing = F.array().cast(f"array<struct<kind:string,key:string,video_id:string,seconds:{SECONDS}>>")
    videos = F.array(entry("video", F.col("source"), F.col("video_id"), duration))
    entries = F.concat(videos, *[F.coalesce(c, nothing) for c in (category, tags)])
    counted = scenes.select(F.inline(entries)).groupBy("kind", "key", "video_id")
    return counted.agg(F.count("*").alias("n"), F.sum("seconds").cast(SECONDS).alias("seconds")).select(*FIGURES.fieldNames())


def stats(scenes: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """Every figure in long form: ``metric, key, value``.

    The breakdowns stay distributed, however many categories there are. Each branch reads only its
    own columns.
    """
    return _long_form(
        scene_totals(scenes), category_breakdown(scenes), source_breakdown(scenes), top_tags(scenes), prompts, scenes.sparkSession
    )


def stats_of(partials: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """``stats`` from the ``partial_figures`` of all batches, without reading a scene."""
    videos = partials.filter("kind = 'video'")
    totals = videos.agg(
        F.countDistinct("video_id").alias("total_assets"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_scenes"),
        F.coalesce(F.sum("seconds"), F.lit(0)).cast(SECONDS).alias("total_duration_seconds"),
    )

    def summed(kind: str, name: str) -> DataFrame:
        return partials.filter(F.col("kind") == kind).groupBy(F.col("key").alias(name)).agg(F.sum("n").alias("n"))

    tags = summed("tag", "tag").orderBy(F.desc("n"), "tag").limit(TOP_TAGS)
    sources = source_breakdown(videos.select(F.col("key").alias("source"), "video_id"))
    return _long_form(_with_averages(totals), summed("category", "category"), sources, tags, prompts, partials.sparkSession)


def _long_form(
    totals: DataFrame, categories: DataFrame, sources: DataFrame, tags: DataFrame, prompts: DataFrame | None, spark: SparkSession
) -> DataFrame:
    single = [
        "total_assets",
        "total_scenes",
        "average_scenes_per_asset",
        "total_duration_seconds",
        "avg_scene_duration_seconds",
    ]
    totals = totals.select(*[F.col(c).cast("double").alias(c) for c in single])
    figures = totals.unpivot([], single, "metric", "value").select("metric", F.lit("").alias("key"), "value")

    def entries(df: DataFrame, metric: str, key: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.col(key).alias("key"), F.col("n").cast("double").alias("value"))

    videos = total_prompt_videos(spark.range(0) if prompts is None else prompts).withColumnRenamed("total_prompt_videos", "n")
    return (
        figures.unionByName(entries(videos.withColumn("none", F.lit("")), "total_prompt_videos", "none"))
        .unionByName(entries(categories, "category_breakdown", "category"))
        .unionByName(entries(sources, "source_breakdown", "source_class"))
        .unionByName(entries(tags, "top_tags", "tag"))
    )


def stats_document(long_form: DataFrame) -> DataFrame:
    """The figures of bounded number in one row: single ones as columns, source classes and top tags as maps.

    Categories have no bound; they stay in the long form, as its rows with the metric ``category_breakdown``.
    """
    long_form = long_form.filter(F.col("metric") != "category_breakdown")

    def figure(metric: str, kind: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("value"))).cast(kind).alias(metric)

    def breakdown(metric: str) -> Column:
        entry = F.when(F.col("metric") == metric, F.struct("key", F.col("value").cast("bigint")))
        return F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(metric)

    return long_form.agg(
        figure("total_assets", "bigint"),
        figure("total_scenes", "bigint"),
        figure("average_scenes_per_asset", "double"),
        breakdown("source_breakdown"),
        figure("total_duration_seconds", SECONDS),
        figure("avg_scene_duration_seconds", SECONDS),
        breakdown("top_tags"),
        figure("total_prompt_videos", "bigint"),
    )
