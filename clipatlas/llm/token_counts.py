"""Token counts of the documents in flat token files, which have no index.

A flat file is a row of fixed-width ids; an end-of-document id follows each document. The files are cut
into blocks of equal size, each block is searched by a vectorised comparison, and a prefix scan over the
blocks of a file joins what a boundary cuts. A block sends its separators only, never its tokens.

Defined cases: a document without tokens counts 0; tokens after the last separator are a document that is
not ``ended``; an empty file has no documents; bytes after the last whole id are ignored; a folder without
files gives an empty table. A null text is written as a document without tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipatlas.llm import vocabulary

#: Bytes that a task holds at a time.
BLOCK_BYTES = 1 << 22
_TEXTS_AT_A_TIME = 256


def _opened(path: str):
    """The file system of a path and the path in it. Whatever pyarrow reads: local, HDFS, S3, GCS."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, length of the flat files in a folder. Spark lists them; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")


def count_tokens(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, place, first, n_tokens, ended: the documents of flat files, in the order they stand there.

    ``files`` has path and length. ``place`` counts the documents of a file from 0 and ``first`` is the
    position of a document's first token. ``width`` is 2 or 4 bytes an id, little-endian. Blocks are dealt
    out evenly, whatever the size of the file they belong to; the scan has one small row for each block.
    """
    if width not in (2, 4):
        raise ValueError("an id has 2 or 4 bytes")
    step = max(width, block_bytes - block_bytes % width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for path, block, size in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size")), strict=True):
                system, inside = _opened(path)
                with system.open_input_file(inside) as file:
                    data = file.read_at(size, block * step)
                ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", count=len(data) // width)
                ends = np.flatnonzero(ids == end_id) + block * (step // width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["path", "block", "ends"]
                )

    usable = F.col("length") - F.col("length") % width
    blocks = (
        files.where(usable > 0)
        .select("path", usable.alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((usable - 1) / step))).alias("block"))
        .select("path", "length", "block", F.least(F.lit(step).cast("long"), F.col("length") - F.col("block") * step).alias("size"))
    )
    tokens = F.col("length").cast("long") / width
    found = blocks.repartition("path", "block").mapInArrow(search, "path string, block long, ends array<long>")
    in_file = Window.partitionBy("path").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    # The scan: how many separators the earlier blocks have, and where the last of them stands.
    scanned = found.withColumn("before", F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0)).cast("long")).withColumn(
        "last", F.coalesce(F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).over(earlier), F.lit(-1).cast("long"))
    )
    ended = (
        scanned.where(F.size("ends") > 0)
        .select("path", "before", "last", "ends", F.posexplode("ends").alias("at", "end"))
        .select("path", (F.col("before") + F.col("at")).alias("place"),
                F.when(F.col("at") == 0, F.col("last") + 1).otherwise(F.get("ends", F.col("at") - 1) + 1).alias("first"), "end")
        .select("path", "place", "first", (F.col("end") - F.col("first")).alias("n_tokens"), F.lit(True).alias("ended"))
    )
    totals = found.groupBy("path").agg(F.sum(F.size("ends")).cast("long").alias("place"), F.max(F.when(F.size("ends") > 0, F.element_at("ends", -1))).alias("end"))
    left = (
        files.select("path", tokens.cast("long").alias("tokens")).join(totals.hint("merge"), "path")  # grows with the files: no broadcast
        .select("path", "place", (F.coalesce("end", F.lit(-1).cast("long")) + 1).alias("first"), "tokens")
        .where(F.col("first") < F.col("tokens"))
        .select("path", "place", "first", (F.col("tokens") - F.col("first")).alias("n_tokens"), F.lit(False).alias("ended"))
    )
    return ended.unionByName(left)


def write_flat_files(docs: DataFrame, folder: str, sent: Broadcast, pattern: str, end_id: int) -> DataFrame:
    """Encode ``docs`` into flat files of 2-byte ids, a file for each task; returns path, place, doc_id, lazily.

    Write the returned rows as a table before use: only the files they name count. A repeated task writes a
    file under a new name, so the files of lost attempts stay unnamed.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoding = vocabulary.encoder(sent, pattern)
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        system, inside = _opened(path)
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        place = 0
        with system.open_output_stream(inside) as out:
            for batch in batches:
                for begin in range(0, batch.num_rows, _TEXTS_AT_A_TIME):
                    part = batch.slice(begin, _TEXTS_AT_A_TIME)
                    for text in part.column("text"):
                        ids = encoding.encode_ordinary(text.as_py() or "")
                        out.write(np.array([*ids, end_id], "<u2").tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * part.num_rows), pa.array(range(place, place + part.num_rows), pa.int64()), part.column("doc_id")],
                        ["path", "place", "doc_id"],
                    )
                    place += part.num_rows

    return docs.select("doc_id", "text").mapInArrow(task, "path string, place long, doc_id long")
