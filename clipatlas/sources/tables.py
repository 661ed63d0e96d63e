"""The scene and prompt tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from clipatlas.functions.vectors import decode_embedding
from clipatlas.schemas import PROMPTS, SCENE_REQUIRED, SCENE_TEXT_COLUMNS, SCENES

# Where a row lies in its parquet file. It identifies a row of a table without a key.
ROW_PLACE = ["_file", "_row"]


def with_place(stored: DataFrame) -> DataFrame:
    """Adds the ``ROW_PLACE`` columns to rows read from parquet files."""
    return stored.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCENES).parquet(path)


def from_text_vectors(rows: DataFrame, text_col: str = "embedding_json") -> DataFrame:
    """Scene rows from the variant that keeps the vector as JSON text; NULL where it does not decode."""
    return rows.withColumn("embedding", decode_embedding(F.col(text_col))).select(*SCENES.fieldNames())


def scene_columns(scenes: DataFrame) -> DataFrame:
    """The text columns, without the vector."""
    return scenes.select(*SCENE_TEXT_COLUMNS)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROMPTS).parquet(path)


def split_required(rows: DataFrame, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that have every required column, and the others. Parquet does not enforce this itself."""
    missing = F.exists(F.array(*[F.col(c).isNull() for c in required]), lambda absent: absent)
    return rows.filter(~missing), rows.filter(missing)


def scene_writer(rows: DataFrame) -> DataFrameWriter:
    """Writes scenes so that a filter on ``video_id`` can skip files and row groups.

    The rows of a task are sorted by video, without a shuffle, and each file has a bloom filter of its videos.
    """
    rows = rows.select(*SCENES.fieldNames()).sortWithinPartitions("video_id", "timestamp_start", "title")
    bloom = {"parquet.bloom.filter.enabled#video_id": "true", "parquet.bloom.filter.expected.ndv#video_id": 100_000}
    return rows.write.options(compression="zstd", **bloom)


def append_scenes(
    scenes: DataFrame, path: str, by_video: bool = False, required: Sequence[str] = SCENE_REQUIRED, rejects: str | None = None
) -> None:
    """Append scene rows in one bulk write, without a shuffle.

    A row without one of the ``required`` columns goes to the folder ``rejects``; without such a folder it makes
    the write fail. The variant of the table that allows NULL requires nothing. ``by_video`` also gathers the
    rows of a video. The range runs on from the video to its scenes and to the task a row comes from, so neither
    a large video nor many copies of one scene end up in a single task.
    """
    rows = scenes.select(*SCENES.fieldNames())
    if required:
        if rejects is not None:
            rows, others = split_required(rows, required)
            others.write.mode("append").parquet(rejects)
        else:
            present = F.forall(F.array(*[F.col(c).isNotNull() for c in required]), lambda there: there)
            rows = rows.filter(present | F.raise_error(F.lit(f"a scene lacks one of {', '.join(required)}")).cast("boolean"))
    if by_video:
        order = ["video_id", "timestamp_start", "title"]
        rows = rows.withColumn("_task", F.spark_partition_id()).repartitionByRange(*order, "_task")
        rows = rows.drop("_task")
    scene_writer(rows).mode("append").parquet(path)


def stamp_prompts(prompts: DataFrame) -> DataFrame:
    """Give every prompt a new id and the time of the load."""
    return prompts.withColumn("id", F.uuid()).withColumn("created_at", F.current_timestamp()).select(
        *PROMPTS.fieldNames()
    )


def append_prompts(prompts: DataFrame, path: str) -> None:
    """Stamp the rows and append them. No shuffle follows the random id, so a retried task is safe."""
    stamp_prompts(prompts).write.mode("append").parquet(path)


def ensure_tables(spark: SparkSession, database: str, location: str | None = None) -> DataFrame:
    """Create the database and both tables where absent; return the columns of the tables."""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{at}")
    for name, schema in (("scenes", SCENES), ("prompts", PROMPTS)):
        columns = ", ".join(
            f"{f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields
        )
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    listing = [
        (name, c.name, c.dataType)
        for name in ("scenes", "prompts")
        for c in spark.catalog.listColumns(f"{database}.{name}")
    ]
    return spark.createDataFrame(listing, "table_name string, column_name string, data_type string")
