"""Which folders a library consists of: a table of commits that readers follow and that is written last.

Whatever is stored goes to new folders first. One row, appended to the commits as one file, then makes all of it visible at
once: a writer that fails before leaves nothing that anyone reads, and one that stores a batch again replaces what
the name stood for before. Rows are never changed; of the rows of a name the latest counts.

``kind`` says what a commit is: ``batch`` names the folders of a batch of scenes, ``prompts`` those of an upload, and
``index`` those of a clustered table. Rows of a batch that are in a clustered table as well have folders of their own
there; ``indexes`` says to which version of which table they were added. ``covers`` are the folders that a clustered table
was built from: what was stored while it was built, or replaced since, can be told from the commits alone.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipatlas.sources.tables import with_place

COMMIT = T.StructType(
    [
        T.StructField("kind", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("at", T.LongType(), False),
        T.StructField("commit", T.StringType(), False),
        # What the commit makes visible: a folder below the root for each table.
        T.StructField("folders", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("indexes", T.MapType(T.StringType(), T.StringType(), False), False),
        T.StructField("about", T.StringType()),
        T.StructField("covers", T.ArrayType(T.StringType(), False)),
    ]
)


def fresh(name: str) -> str:
    """A folder for one attempt to store ``name``; nobody else writes to it."""
    return f"{name}/attempt={uuid.uuid4().hex}"


def commit(
    spark: SparkSession,
    root: str,
    kind: str,
    name: str,
    folders: dict[str, str],
    indexes: dict[str, str] | None = None,
    about: str | None = None,
    covers: list[str] | None = None,
    at: int | None = None,
) -> None:
    """Make the folders visible. The row is one file, which the file system moves into place as a whole.

    ``at`` is for a commit that says more about an earlier one and must not win over one that has replaced that.
    """
    row = Row(kind=kind, name=name, at=at or time.time_ns(), commit=uuid.uuid4().hex, folders=folders, indexes=indexes or {}, about=about, covers=covers)
    spark.createDataFrame([row], COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _stored(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT).parquet(f"{root}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The commits that count: the latest of each name."""
    latest = Window.partitionBy("kind", "name").orderBy(F.desc("at"), F.desc("commit"))
    return _stored(spark, root).withColumn("nth", F.row_number().over(latest)).filter("nth = 1").drop("nth")


class Snapshot:
    """The folders of a library at one moment. All of its tables are read as of then.

    The driver holds one row for each batch, no more than Spark itself holds for the files in them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.rows = commits(spark, root).orderBy("kind", "name").collect()

    def of(self, kind: str) -> list[Row]:
        return [r for r in self.rows if r.kind == kind]

    def read(self, table: str, schema: T.StructType, rows: list[Row], placed: bool = False) -> DataFrame:
        """The rows that some commits have in a table; none if they have no folder there. Folder names are no columns.

        ``placed`` adds the ``ROW_PLACE`` columns.
        """
        folders = [f"{self.root}/{r.folders[table]}" for r in rows if table in r.folders]
        if not folders:
            empty = self.spark.createDataFrame([], schema)
            return empty.withColumns({"_file": F.lit(""), "_row": F.lit(0).cast("bigint")}) if placed else empty
        stored = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*folders)
        return with_place(stored) if placed else stored

    def index(self, name: str) -> Row | None:
        """The commit of the clustered table that is in use under a name."""
        return next((r for r in self.rows if r.kind == "index" and r.name == name), None)
