"""Model responses arriving as files, appended to the scene table as they come."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clipatlas.operators.embed import HASH_DIMS, embed_once
from clipatlas.operators.ivf import About, ivf_fitting, ivf_write, named
from clipatlas.operators.stats import partial_figures
from clipatlas.schemas import BROKEN_RECORD, RESPONSE_RECORD, SCENES
from clipatlas.sources.commits import Snapshot, commit, fresh
from clipatlas.sources.responses import parse_responses, to_scene_rows
from clipatlas.sources.tables import scene_writer


def parsed_documents(documents: DataFrame) -> DataFrame:
    """The documents with ``analysis`` and whether they are ``accepted``.

    A document is accepted as a whole: a valid response, about a video and a source that are named. Start and
    end times, which the scene table requires too, are texts in every valid response.
    """
    named = F.col("video_id").isNotNull() & F.col("source").isNotNull()
    return parse_responses(documents).withColumn("accepted", F.col("valid") & named).drop("valid")


def scenes_and_rejects(parsed: DataFrame, load=None, dims: int = HASH_DIMS) -> tuple[DataFrame, DataFrame]:
    """Scene rows with embeddings, and the rejected documents as they came, of ``parsed_documents``."""
    rows = to_scene_rows(parsed.filter("accepted"))
    scenes = embed_once(rows, "description", "embedding", load, dims).select(*SCENES.fieldNames())
    return scenes, parsed.filter("NOT accepted").drop("accepted", "analysis")


# What commits call the scene table's folders and its clustered table, which lies below this folder.
SCENE_INDEX, CELLS = "scene_cells", "cells"
ORIGIN = "origin"


def with_origin(stored: DataFrame) -> DataFrame:
    """Adds the attempt that stored a row, which tells rows of a batch apart from those that replaced them."""
    return stored.withColumn(ORIGIN, F.regexp_extract("_metadata.file_path", "attempt=([0-9a-f]+)", 1))


def store_documents(documents: DataFrame, target: str, batch: str, load=None, dims: int = HASH_DIMS) -> dict[str, str]:
    """Store a batch of documents as scenes and rejects below ``target``; their folders, by table.

    Both, the figures of the batch, and the rows in cells if the scenes have a clustered table, become visible at once,
    by a commit that comes last. A batch that is stored again under its name replaces what it stored before. The documents are parsed once.
    """
    spark = documents.sparkSession
    folders = {name: fresh(f"{name}/{batch}") for name in ("scenes", "rejects")}
    parsed = parsed_documents(documents).persist()
    try:
        scenes, rejects = scenes_and_rejects(parsed, load, dims)
        rejects.hint("rebalance").write.parquet(f"{target}/{folders['rejects']}")
        scene_writer(scenes.hint("rebalance")).parquet(f"{target}/{folders['scenes']}")
    finally:
        parsed.unpersist()
    stored = with_origin(spark.read.schema(SCENES).parquet(f"{target}/{folders['scenes']}"))
    folders["figures"] = fresh(f"figures/{batch}")
    partial_figures(stored).write.parquet(f"{target}/{folders['figures']}")
    cells, indexes = into_cells(Snapshot(spark, target), SCENE_INDEX, stored, f"{target}/{CELLS}")
    commit(spark, target, "batch", batch, folders | cells, indexes)
    return folders


def into_cells(snapshot: Snapshot, name: str, rows: DataFrame, path: str) -> tuple[dict[str, str], dict[str, str]]:
    """Write rows into the cells of a clustered table, if there is one: what a commit then says of it.

    Rows that do not fit, for their vectors are of another length or the table was built from none, stay
    outside the cells; a search looks at them all the same.
    """
    index = snapshot.index(name)
    if index is None:
        return {}, {}
    about = About(*json.loads(index.about))
    try:
        fits = ivf_fitting(rows, about) == about
    except ValueError:
        fits = False
    if not fits:
        return {}, {}
    return named(name, ivf_write(rows, path, about)), {name: about.identity}


def stream_ingest(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    load=None,
    dims: int = HASH_DIMS,
    max_files_per_trigger: int = 1000,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the ingestion from JSON-lines files in ``source``.

    Each micro-batch is a batch of ``store_documents``, ``ingest=<id>/ingest_batch=<n>``. The id is that of the
    streaming query, which lives in the checkpoint: a batch repeated after a failure replaces itself, and another
    stream, or one that lost its checkpoint, stores others.
    A line that is no JSON object becomes a reject with its text.
    """
    arriving = (
        spark.readStream.schema(RESPONSE_RECORD)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .option("columnNameOfCorruptRecord", BROKEN_RECORD)
        .json(source)
    )

    def store(batch: DataFrame, batch_id: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first().value)["id"]
        store_documents(batch, target, f"ingest={stream}/ingest_batch={batch_id}", load, dims)

    writer = arriving.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def ingested(spark: SparkSession, target: str, name: str = "scenes") -> DataFrame:
    """What streams have stored so far, with the stream and the number of the micro-batch."""
    schema = {"scenes": SCENES, "rejects": RESPONSE_RECORD}[name]
    batches = [r for r in Snapshot(spark, target).of("batch") if r.name.startswith("ingest=")]
    if not batches:
        return spark.createDataFrame([], schema).withColumns({"ingest": F.lit(""), "ingest_batch": F.lit(0).cast("bigint")})
    folders = [f"{target}/{r.folders[name]}" for r in batches]
    read = spark.read.schema(schema).option("basePath", f"{target}/{name}").parquet(*folders)
    return read.withColumn("ingest_batch", F.col("ingest_batch").cast("bigint")).drop("attempt")
