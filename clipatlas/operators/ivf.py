"""Clustered vector tables: rows stored by their nearest centroids, searched a few cells at a time.

The centroids are a table (see ``centroids``). Beside its rows a build, and every batch that is added, keeps for each cell
how many rows it has and the least cosine of any of them to the centroid, which bounds how near a row of the cell
can be to a query: that makes a search exact that opens only the cells which may still hold a nearer row.

What a clustered table consists of is told by commits (see ``commits``): files of a build or a batch are visible once all
are written, and a batch that is added again replaces what it added before.
"""

from __future__ import annotations

import json
import math
import sys
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipatlas.functions.vectors import norm, usable
from clipatlas.operators import centroids as levels
from clipatlas.operators.knn import QUERY_BLOCK_BYTES, SCENE_ORDER, chunks_of, deal, knn_join, nearest, nearest_each, written
from clipatlas.operators.search import (
    PROMPT_BRANCH_RESULTS,
    PROMPT_COLUMNS,
    PROMPT_RESULTS,
    SCENE_RESULTS,
    best_prompts,
    nearest_places,
    prompt_search,
    scenes_at,
)
from clipatlas.sources.commits import Snapshot, commit, fresh
from clipatlas.sources.tables import ROW_PLACE, with_place

# Which cells a query looks into is also worked out in tasks; the code goes to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cell of the rows without a direction (zero vectors). Every search looks into it.
NO_CELL = -1
# What the commits of a clustered table by itself call it.
_CURRENT = "current"
# Cells that a search looks into are set at the build so that it finds this share of the nearest distinct vectors,
# on average over so many stored vectors that are searched for, among those of so many rows.
_RECALL, _MEASURED, _MEASURED_ROWS = 0.95, 200, 1_000_000
# An exact batch search of a table that needs more than one in so many cells for that leaves the cells alone: listing them for
# every query costs more than they spare.
_WORTHWHILE = 4
# A cell is split if it has more than so many times the mean rows, and dissolved if the mean is more than so many times its.
_GROWN, _SHRUNK = 4, 16
# Sampled rows at least, if there are so many.
_LEAST_SAMPLE = 4096
# Up to this size centroids are sent to the tasks that assign rows; more are dealt out with the rows.
SENT_CENTROIDS = 32 << 20
# More than the rounding of an angle that is worked out from a cosine.
_ANGLE_SLACK = 1e-7
_REACH = "cell int, n_rows long, toward double"


class About(NamedTuple):
    """What a clustered table is."""

    vec_col: str
    dims: int | None
    # Column names and types of the stored rows, as JSON.
    stored: str
    version: str
    # Cells that a search looks into unless it says how many; None for all.
    nprobe: int | None
    # Cells with a centroid; 0 if the vectors could not be told apart.
    n_cells: int
    # Folder of the centroids in use, and the number that the next new cell gets.
    centroids: str = "centroids"
    next_cell: int = 0
    # For each time that cells were split or merged, those whose rows were moved to other cells.
    retired: list[list[int]] = []

    @property
    def identity(self) -> str:
        """What rows have to be added for, to be looked for in the right cells."""
        return f"{self.version}/{self.centroids}"

    def moved(self, generation: int) -> list[int]:
        """Cells that folders written after so many changes of the cells still hold rows of, which lie elsewhere now."""
        return sorted({c for cells in self.retired[generation:] for c in cells})

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.stored))


class Clustered(NamedTuple):
    """A clustered table as of one moment: its description, and the folders that hold rows and the reach of cells."""

    spark: SparkSession
    path: str
    about: About
    rows: list[str]
    reach: list[str]
    # For each folder of rows, after how many changes of the cells it was written; those of the index itself come first.
    generations: list[int]
    own: int = 1
    # Rows that are stored elsewhere and not in a cell yet, with their place. Every search looks at them.
    loose: DataFrame | None = None
    # Values of the column ``origin`` whose rows have been replaced since; no search finds them.
    stale: tuple[str, ...] = ()


def _outside() -> dict[str, Column]:
    """What rows outside the cells have for a place."""
    return {"toward": F.lit(0.0), "cell": F.lit(NO_CELL), "coarse": F.lit(NO_CELL)}


def _directed(length: Column) -> Column:
    # NaN is the largest number to Spark, so it fails the second test.
    return (length > 0) & (length < float("inf"))


def default_cells(rows: int) -> int:
    """About the square root of the row count, as usual for inverted files."""
    return int(max(1, round(rows**0.5)))


def ivf_build(
    rows: DataFrame,
    path: str,
    vec_col: str = "embedding",
    nlist: int | None = None,
    seed: int = 7,
    training_fraction: float | None = None,
) -> None:
    """Cluster the vectors and store all rows with a usable one under ``path``, by cell.

    The centroids are fitted on a sample of ``centroids.PER_CENTROID`` rows for each, or on the share of all rows
    that is asked for; every row is assigned. ``rows`` is read several times, so it should be a stored table. All files
    of a build lie in a folder of its own, and the commit that names it comes last: a build that fails leaves what was
    there before. It holds the number of cells that a search has to look into, as measured on the stored rows.
    """
    about, folders = ivf_write_build(rows, path, vec_col, nlist, seed, training_fraction)
    ivf_commit(rows.sparkSession, path, _CURRENT, about, folders)


def ivf_commit(spark: SparkSession, root: str, name: str, about: About, folders: dict[str, str], covers: list[str] | None = None) -> None:
    """Make a build the clustered table in use under a name."""
    commit(spark, root, "index", name, named(name, folders), {}, json.dumps(about), covers)


def named(name: str, folders: dict[str, str]) -> dict[str, str]:
    """What a commit calls the folders of the clustered table ``name``."""
    return {f"{name}.{kind}": folder for kind, folder in folders.items()}


def ivf_write_build(
    rows: DataFrame, path: str, vec_col: str, nlist: int | None = None, seed: int = 7, training_fraction: float | None = None
) -> tuple[About, dict[str, str]]:
    """The files of ``ivf_build``, for a caller that commits them: what they are, and their folders."""
    spark = rows.sparkSession
    vec = F.col(vec_col)
    facts = rows.select(vec_col).filter(usable(vec)).agg(
        F.count("*").alias("n"),
        F.min(F.size(vec)).alias("least"),
        F.max(F.size(vec)).alias("dims"),
    ).first()
    if facts.n and facts.least != facts.dims:
        raise ValueError("vectors differ in length")
    nlist = nlist or default_cells(facts.n)
    version = f"build-{uuid.uuid4().hex}"
    n_cells = 0
    if facts.n:
        wanted = max(_LEAST_SAMPLE, levels.PER_CENTROID * nlist)
        share = min(1.0, wanted / facts.n) if training_fraction is None else training_fraction
        directed = rows.filter(usable(vec)).filter(_directed(norm(vec))).select(vec.cast("array<double>").alias("vector"))
        n_cells = levels.fit((directed if share == 1.0 else directed.sample(share, seed)).distinct(), facts.dims, nlist, f"{path}/{version}", seed)
    stored = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("norm", "toward")], *[T.StructField(n, T.IntegerType()) for n in ("cell", "coarse")]])
    about = About(vec_col, facts.dims, stored.json(), version, None, n_cells, next_cell=n_cells, retired=[])
    folders = ivf_write(rows, path, about)
    built = Clustered(spark, path, about, [folders["rows"]], [folders["reach"]], [0])
    return ivf_measured(built), folders


def ivf_append(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Add rows to a clustered table, into the cells it already has.

    Rows without a vector are not kept, as in ``ivf_build``; vectors of another length raise, and nothing is
    stored. A batch that is added again under its name replaces what it added before. A table that was built
    from no vectors takes the length of the first ones added.
    """
    spark = rows.sparkSession
    table = ivf_open(spark, path)
    about = ivf_fitting(rows, table.about)
    if about != table.about:
        ivf_commit(spark, path, _CURRENT, about, _base(table))
    commit(spark, path, "batch", batch or uuid.uuid4().hex, named(_CURRENT, ivf_write(rows, path, about)), {_CURRENT: about.identity})


def _base(table: Clustered) -> dict[str, str]:
    """Folders of the index itself, without the batches added since."""
    folders = {}
    for i, generation in enumerate(table.generations[: table.own]):
        folders |= {f"{kind}.{generation}.{i}": names[i] for kind, names in (("rows", table.rows), ("reach", table.reach))}
    return folders


def ivf_fitting(rows: DataFrame, about: About) -> About:
    """Raise unless the vectors have the length of the table's. A table without vectors takes their length."""
    size = F.size(F.col(about.vec_col))
    facts = rows.filter(size > 0).agg(F.min(size).alias("least"), F.max(size).alias("most")).first()
    if facts.least is not None and not facts.least == facts.most == (about.dims or facts.least):
        raise ValueError("vectors differ in length")
    return about._replace(dims=about.dims or facts.least)


def ivf_exists(spark: SparkSession, path: str) -> bool:
    return Snapshot(spark, path).index(_CURRENT) is not None


def ivf_open(spark: SparkSession, path: str) -> Clustered:
    """The table as of now."""
    table = ivf_of(Snapshot(spark, path), _CURRENT, path)
    if table is None:
        raise ValueError(f"no clustered table at {path}")
    return table


def ivf_of(snapshot: Snapshot, name: str, path: str) -> Clustered | None:
    """The table in use under a name as of a snapshot, with the batches that were added to it; None if there is none."""
    index = snapshot.index(name)
    if index is None:
        return None
    about = About(*json.loads(index.about))
    # Folders of the index are called rows for the build, and rows.<generation>.<number> once cells have been changed.
    own = sorted((int(g or 0), int(i or 0), kind) for kind in index.folders if kind.startswith(f"{name}.rows") for g, i in [(kind[len(name) + 6 :] + ".").split(".")[:2]])
    added = [r for r in snapshot.rows if r.indexes.get(name) == about.identity]
    rows = [index.folders[kind] for *_, kind in own] + [r.folders[f"{name}.rows"] for r in added]
    reach = [index.folders[kind.replace(f"{name}.rows", f"{name}.reach")] for *_, kind in own] + [r.folders[f"{name}.reach"] for r in added]
    return Clustered(snapshot.spark, path, about, rows, reach, [g for g, *_ in own] + [len(about.retired)] * len(added), len(own))


def _centroids(table: Clustered) -> DataFrame:
    """cell, coarse, centre: unit vectors; none if the table is not clustered."""
    if not table.about.n_cells:
        return table.spark.createDataFrame([], levels.CENTROIDS)
    return table.spark.read.schema(levels.CENTROIDS).parquet(f"{table.path}/{table.about.identity}")


def ivf_write(rows: DataFrame, path: str, about: About) -> dict[str, str]:
    """Assign a cell to every row with a usable vector and write the rows by cell, and the reach of the cells.

    Folders are those of the coarse centroids, and rows are sorted by cell in their files, so that a search reads few
    folders and, of a file, the pages of its cells; there are no more files than the tasks that write make folders.
    Rows are gathered by coarse centroid and the writing tasks evened out by adaptive execution: small ones share
    a task, and one that holds a large part of the table, such as many copies of one vector, is split by
    where its rows come from. Nothing is visible until the folders are committed.
    """
    spark, home = rows.sparkSession, f"{path}/{about.version}"
    vec, dims = F.col(about.vec_col), about.dims
    kept = rows.filter(usable(vec, dims)).withColumn("norm", norm(vec))
    if about.n_cells:
        placed = _assigned(kept, path, about)
    else:
        placed = kept.withColumns(_outside())
    folders = {"rows": fresh("rows"), "reach": fresh("reach")}
    gathered = placed.select(*about.schema.fieldNames()).hint("rebalance", "coarse").sortWithinPartitions("coarse", "cell")
    gathered.write.partitionBy("coarse").parquet(f"{home}/{folders['rows']}")
    read = _read_rows(spark, path, about, [folders["rows"]])
    cells = read.groupBy("cell").agg(F.count("*").alias("n_rows"), F.min("toward").alias("toward"))
    cells.write.parquet(f"{home}/{folders['reach']}")
    return folders


def _assigned(kept: DataFrame, path: str, about: About) -> DataFrame:
    """Rows with their ``cell`` and ``toward``, the cosine to its centroid."""
    spark, dims, home = kept.sparkSession, about.dims, f"{path}/{about.version}"
    vec, directed = F.col(about.vec_col).cast("array<double>"), _directed(F.col("norm"))
    coarse = levels.load_coarse(spark, home)
    if about.n_cells * dims * 8 <= SENT_CENTROIDS:
        place = levels.two_levels(coarse, levels.load_fine(spark, f"{path}/{about.identity}", dims))(F.when(directed, vec))
        placed = kept.withColumn("_place", place)
        return placed.withColumns({c: F.col(f"_place.{c}") for c in ("coarse", "cell", "toward")}).drop("_place")
    table = spark.read.schema(levels.CENTROIDS).parquet(f"{path}/{about.identity}")
    rows = kept.withColumn("coarse", coarse.place(F.when(directed, vec)))
    sizes = {r["coarse"]: r["count"] for r in rows.groupBy("coarse").count().collect()}  # one row for each coarse centroid
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, chunks_of(n, dims))]) if sizes else F.lit(None).cast("map<int,int>")
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts[F.col("coarse")]).cast("int")
    dealt = rows.withColumn("_part", part)
    asked = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(parts[F.col("coarse")], F.lit(1)) - 1)))
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("toward", T.DoubleType())])
    vec_col, nothing = about.vec_col, spark.createDataFrame([], schema).toArrow()

    def task(some: pa.Table, below: pa.Table) -> pa.Table:
        if not some.num_rows:
            return nothing
        cell, toward = levels.place_below(some.column(vec_col).combine_chunks(), below, dims)
        return some.drop_columns(["_part"]).append_column("cell", pa.array(cell, pa.int32())).append_column("toward", pa.array(toward))

    return dealt.groupBy("coarse", "_part").cogroup(asked.groupBy("coarse", "_part")).applyInArrow(task, schema)


def _read_rows(spark: SparkSession, path: str, about: About, folders: list[str]) -> DataFrame:
    home = f"{path}/{about.version}"
    read = spark.read.schema(about.schema).option("basePath", f"{home}/rows").parquet(*[f"{home}/{f}" for f in folders])
    return read.select(*about.schema.fieldNames())


def _by_generation(table: Clustered, folders: list[str]) -> list[tuple[list[str], Column]]:
    """Folders written after as many changes of the cells, and which of their rows are still looked for there."""
    found = []
    for generation in sorted(set(table.generations)):
        moved = table.about.moved(generation)
        same = [f for f, g in zip(folders, table.generations, strict=True) if g == generation]
        found.append((same, ~F.col("cell").isin(moved) if moved else F.lit(True)))
    return found


def _rows(table: Clustered, placed: bool = False) -> DataFrame:
    """All rows: those of the cells, and the loose ones as rows outside the cells. ``placed`` adds the ``ROW_PLACE`` columns."""
    rows = None
    for folders, there in _by_generation(table, table.rows):
        part = _read_rows(table.spark, table.path, table.about, folders)
        part = (with_place(part) if placed else part).filter(there)
        rows = part if rows is None else rows.unionByName(part)
    if table.stale:
        rows = rows.filter(~F.col("origin").isin(*table.stale))
    if table.loose is None:
        return rows
    vec = F.col(table.about.vec_col)
    loose = table.loose.filter(usable(vec, table.about.dims)).withColumns({"norm": norm(vec), **_outside()})
    return rows.unionByName(loose.select(*rows.columns))


def _of_cells(table: Clustered) -> Callable[[DataFrame, list[int]], DataFrame]:
    """Restricts rows to some cells, by their folders first, and to those outside the cells."""
    if not table.about.n_cells:
        return lambda rows, cells: rows

    def restricted(rows: DataFrame, cells: list[int]) -> DataFrame:
        above = _centroids(table).filter(F.col("cell").isin(cells)).select("coarse").distinct().collect()
        return rows.filter(F.col("coarse").isin([NO_CELL, *sorted(r.coarse for r in above)]) & F.col("cell").isin([NO_CELL, *cells]))

    return restricted


def _opened(spark: SparkSession, path: str | Clustered) -> Clustered:
    return path if isinstance(path, Clustered) else ivf_open(spark, path)


def ivf_rows(spark: SparkSession, path: str | Clustered) -> DataFrame:
    return _rows(_opened(spark, path)).drop("toward", "coarse")


def ivf_reach(table: Clustered) -> DataFrame:
    """cell, n_rows, toward: for each cell how many rows it has, and the least cosine of any to the centroid."""
    home, read = f"{table.path}/{table.about.version}", None
    for folders, there in _by_generation(table, table.reach):
        part = table.spark.read.schema(_REACH).parquet(*[f"{home}/{f}" for f in folders]).filter(there)
        read = part if read is None else read.unionByName(part)
    return read.groupBy("cell").agg(F.sum("n_rows").alias("n_rows"), F.min("toward").alias("toward"))


def ivf_cells(spark: SparkSession, path: str | Clustered) -> DataFrame:
    """Rows per cell and the share of the largest, to judge how even the clustering is."""
    sizes = ivf_reach(_opened(spark, path)).select("cell", "n_rows")
    total = sizes.agg(F.sum("n_rows")).scalar()
    return sizes.withColumn("share", F.col("n_rows") / total)


def _measured_probes(table: Clustered) -> int | None:
    """Cells that ``_RECALL`` of the nearest distinct vectors lie in, those of the query itself left out; None for all.

    Asked are ``_MEASURED`` vectors of the build and as many of the batches added since, and the larger need of the two
    counts, so that rows of another distribution are found as well. They are taken from the different vectors of a
    share of the rows that the hash of a vector decides, so that it is there with all its copies or not at all. The
    driver sees those asked, and for each the centroids that its neighbours lie at.
    """
    about = table.about
    if not about.n_cells:
        return None
    n = ivf_reach(table).agg(F.sum("n_rows")).first()[0]
    share = min(1.0, _MEASURED_ROWS / max(1, n))
    own = table.own
    parts = [
        table._replace(rows=table.rows[at], reach=table.reach[at], generations=table.generations[at], loose=None)
        for at in (slice(own), slice(own, None))
    ]
    some = None
    for added, part in enumerate(parts):
        if part.rows:
            rows = _rows(part).filter(F.col("cell") != NO_CELL).select(F.col(about.vec_col).alias("vector"), "cell", F.lit(added).alias("added"))
            some = rows if some is None else some.unionByName(rows)
    if share < 1:
        some = some.filter(F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    distinct = some.groupBy("vector").agg(F.min("cell").alias("in_cell"), F.min("added").alias("added")).withColumn("id", F.xxhash64("vector"))
    distinct = written(distinct, "distinct")
    asked = []
    for added in range(2 if len(table.rows) > own else 1):
        first = distinct.filter(F.col("added") == added).orderBy("id").limit(_MEASURED)
        asked += first.select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("query_embedding"), "added").collect()
    vectors = np.array([q.query_embedding for q in asked])
    found = nearest_each(distinct.drop("added"), [q.query_id for q in asked], vectors, SCENE_RESULTS + 1, "vector", ("id",))
    hits = found.filter("id != query_id").select("query_id", "in_cell").collect()
    if not hits:
        return None
    place = {q.query_id: i for i, q in enumerate(asked)}
    vectors = levels.unit(vectors)
    # How near the centroid of each hit is to the query, and then how many centroids are nearer.
    small = about.n_cells * about.dims * 8 <= SENT_CENTROIDS
    table_of = _centroids(table).select("cell", "centre")
    own_rows = table_of.toArrow() if small else table_of.filter(F.col("cell").isin(sorted({h.in_cell for h in hits}))).toArrow()
    own = dict(zip(own_rows.column("cell").to_pylist(), levels.rows_of(own_rows.column("centre").combine_chunks(), about.dims), strict=True))
    of, dims = np.array([place[h.query_id] for h in hits]), about.dims
    near = np.einsum("ij,ij->i", vectors[of], np.array([own[h.in_cell] for h in hits]))

    def nearer(batches):
        total = np.zeros(len(of), np.int64)
        for batch in batches:
            centres = levels.rows_of(batch.column("centre"), dims)
            for at in range(0, len(centres), 4096):
                total += ((vectors @ centres[at : at + 4096].T)[of] > near[:, None] + 1e-12).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(of))), pa.array(total)], ["hit", "n"])

    if small:
        needs = dict(enumerate(n + 1 for batch in nearer(iter(own_rows.to_batches())) for n in batch.column("n").to_pylist()))
    else:
        counts = table_of.mapInArrow(nearer, "hit long, n long").groupBy("hit").agg(F.sum("n").alias("n"))
        needs = {r.hit: int(r.n) + 1 for r in counts.collect()}
    most = 0
    for added in range(2):
        needed = sorted(n for hit, n in needs.items() if asked[of[hit]].added == added)
        if needed:
            most = max(most, needed[int(np.ceil(_RECALL * len(needed))) - 1])
    return most


def ivf_measure(spark: SparkSession, path: str) -> int | None:
    """Measure again how many cells a search has to look into, after rows were appended, and keep the result."""
    table = ivf_open(spark, path)
    about = ivf_measured(table)
    ivf_commit(spark, path, _CURRENT, about, _base(table))
    return about.nprobe


def ivf_measured(table: Clustered) -> About:
    """The description of a table with the probes measured on the rows it has now."""
    return table.about._replace(nprobe=_measured_probes(table))


def ivf_rebalance(spark: SparkSession, path: str) -> bool:
    """Let the cells follow the rows: split those that grew and dissolve those that shrank. Not while rows are appended.

    Says whether there was anything to do.
    """
    table = ivf_open(spark, path)
    changed = ivf_write_rebalanced(table)
    if changed is not None:
        ivf_commit(spark, path, _CURRENT, *changed)
    return changed is not None


def ivf_write_rebalanced(table: Clustered) -> tuple[About, dict[str, str]] | None:
    """The files of ``ivf_rebalance``, for a caller that commits them: the new description and all folders.

    A cell with more than ``_GROWN`` times the mean gets centroids of its own, fitted on a sample of its different
    vectors; one with less than the mean by ``_SHRUNK`` loses its centroid, unless no other lies below the same coarse
    one. Only the rows of these cells are read and written anew. The driver sees their numbers and sizes.
    """
    spark, about = table.spark, table.about
    if not about.n_cells:
        return None
    sizes = ivf_reach(table).filter(F.col("cell") != NO_CELL)
    mean = (sizes.agg(F.sum("n_rows")).first()[0] or 0) / about.n_cells
    grown = {r.cell: r.n_rows for r in sizes.filter(F.col("n_rows") > _GROWN * mean).collect()}
    split = _split(table, grown, mean) if grown else None
    pieces = {} if split is None else {r.parent: r.n for r in split.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    whole = _centroids(table).join(sizes, "cell", "left").filter(~F.col("cell").isin(list(pieces)) if pieces else F.lit(True))
    # The largest cell below each coarse centroid stays.
    place = F.row_number().over(Window.partitionBy("coarse").orderBy(F.desc_nulls_last("n_rows"), "cell"))
    small = (F.coalesce("n_rows", F.lit(0)) * _SHRUNK < mean) & (place > 1)
    ranked = written(whole.withColumn("small", small), "centroids")
    gone = [r.cell for r in ranked.filter("small").select("cell").collect()]
    if not gone and not pieces:
        return None
    kept = ranked.filter("NOT small").select(*levels.CENTROIDS.fieldNames())
    after = about._replace(centroids=f"centroids-{uuid.uuid4().hex}", next_cell=about.next_cell + sum(pieces.values()), retired=[*about.retired, [*gone, *pieces]])
    (kept if split is None else kept.unionByName(split.drop("parent"))).write.parquet(f"{table.path}/{after.identity}")
    n_cells = spark.read.schema(levels.CENTROIDS).parquet(f"{table.path}/{after.identity}").count()
    after = after._replace(n_cells=n_cells)
    moving = _rows(table._replace(loose=None)).filter(F.col("cell").isin([*gone, *pieces]))
    added = ivf_write(moving.drop("norm", "toward", "cell", "coarse"), table.path, after)
    rows, reach = [*table.rows, added["rows"]], [*table.reach, added["reach"]]
    changed = table._replace(about=after, rows=rows, reach=reach, generations=[*table.generations, len(after.retired)], own=len(rows), loose=None)
    return ivf_measured(changed), _base(changed)


def _split(table: Clustered, grown: dict[int, int], mean: float) -> DataFrame | None:
    """Centroids (parent, cell, coarse, centre) in the place of those of cells that grew; none for copies of one vector."""
    about, seed = table.about, len(table.about.retired)
    many = {cell: min(levels.FINE_MOST, math.ceil(n / mean)) for cell, n in grown.items()}
    share = F.create_map(*[F.lit(x) for cell, n in grown.items() for x in (cell, min(1.0, levels.PER_CENTROID * many[cell] / n))])
    # By the place of a row in the table, so that copies of one vector do not all come.
    rows = _rows(table._replace(loose=None)).filter(F.col("cell").isin(list(grown)))
    some = rows.filter(F.rand(seed) < share[F.col("cell")]).select("cell", F.col(about.vec_col).cast("array<double>").alias("vector")).distinct()
    above = _centroids(table).select("cell", "coarse")
    dims, schema = about.dims, "parent int, coarse int, nth int, centre array<double>"

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        cell = int(frame["cell"].iloc[0])
        centres = levels.fit_centres(levels.unit(np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), dims)), many[cell], seed)
        centres = centres if len(centres) > 1 else centres[:0]
        return pd.DataFrame({"parent": cell, "coarse": int(frame["coarse"].iloc[0]), "nth": np.arange(len(centres)), "centre": centres.tolist()})

    fitted = written(some.join(above, "cell").groupBy("cell").applyInPandas(fit, schema), "centroids")
    if fitted.isEmpty():
        return None
    sizes = fitted.groupBy("parent").agg(F.count("*").alias("n")).orderBy("parent").collect()  # as many as cells that grew
    begins, at = {}, about.next_cell
    for r in sizes:
        begins[r.parent], at = at, at + r.n
    first = F.create_map(*[F.lit(x) for pair in begins.items() for x in pair])[F.col("parent")]
    return fitted.select("parent", (first + F.col("nth")).cast("int").alias("cell"), "coarse", "centre")


def _probes(table: Clustered, nprobe: int | None) -> int | None:
    """How many cells to look into; None for all."""
    n = nprobe or table.about.nprobe
    return n if n is not None and n < table.about.n_cells else None


def ivf_candidates(spark: SparkSession, path: str | Clustered, query: Sequence[float], nprobe: int | None = None) -> DataFrame:
    """Rows of the cells nearest to the query, as many as measured unless ``nprobe`` is given; the other cells' folders are not read."""
    table = _opened(spark, path)
    return _near_rows(table, _rows(table), query, nprobe).drop("toward", "coarse")


def _near_rows(table: Clustered, rows: DataFrame, query: Sequence[float], nprobe: int | None) -> DataFrame:
    probes = _probes(table, nprobe)
    return rows if probes is None else _of_cells(table)(rows, _nearest_cells(table, query, probes))


def _nearest_cells(table: Clustered, query: Sequence[float], probes: int) -> list[int]:
    near = nearest(_centroids(table).select("cell", "centre"), query, probes, vec_col="centre", order=("cell",))
    return sorted(r.cell for r in near.select("cell").collect())


def ivf_search(
    spark: SparkSession,
    path: str | Clustered,
    query: Sequence[float],
    k: int = SCENE_RESULTS,
    nprobe: int | None = None,
    bucket: str | None = None,
) -> DataFrame:
    """Approximate ``scene_search`` by cosine; exact when ``nprobe`` covers every cell.

    Texts are read from the files that hold a winner only.
    """
    table = _opened(spark, path)
    rows = _near_rows(table, _rows(table, True), query, nprobe)
    return scenes_at(rows, nearest_places(rows, query, k), bucket)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def ivf_reaching(table: Clustered, query: Sequence[float], close: float) -> DataFrame:
    """The cells that may hold a row as close to the query as ``close``, with that ``bound``, the nearest first.

    The angle between the query and a row is at least that to the centroid less the widest angle of any row
    of the cell to it.
    """
    length = math.sqrt(sum(x * x for x in query))
    if not 0 < length < math.inf:
        # Without a direction every row is as close as any other.
        return ivf_reach(table).withColumn("bound", F.lit(0.0)).filter(F.lit(close <= 0))
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    toward_query = F.aggregate(F.zip_with("centre", unit, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    apart = _angle(toward_query) - _angle(F.col("toward")) - F.lit(_ANGLE_SLACK)
    bound = F.when(apart <= 0, F.lit(1.0)).otherwise(F.cos(apart))
    cells = ivf_reach(table).join(_centroids(table), "cell").select("cell", "n_rows", bound.alias("bound"))
    return cells.filter(F.col("bound") >= F.lit(close)).orderBy(F.desc("bound"))


def ivf_search_exact(
    spark: SparkSession,
    path: str | Clustered,
    query: Sequence[float],
    k: int = SCENE_RESULTS,
    bucket: str | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """``scene_search`` by cosine, exact, reading only the cells that may hold one of the nearest.

    The nearest cells are searched first; how close their k-th best row is decides which others are opened.
    """
    table = _opened(spark, path)
    rows, probes = _rows(table, True), _probes(table, nprobe)
    if probes is None:
        return scenes_at(rows, nearest_places(rows, query, k), bucket)
    of_cells, first = _of_cells(table), _nearest_cells(table, query, probes)
    found = nearest_places(of_cells(rows, first), query, k)
    close = found[-1]["_close"] if len(found) == k else -math.inf
    more = [r.cell for r in ivf_reaching(table, query, close).filter(~F.col("cell").isin(first)).select("cell").collect()]
    if more:
        found += nearest_places(of_cells(rows, more).filter(F.col("cell") != NO_CELL), query, k)
        # NULL comes first, as in Spark.
        found.sort(key=lambda r: (-r["_close"], *((r[c] is not None, r[c] or "") for c in SCENE_ORDER)))
    return scenes_at(of_cells(rows, first + more), found[:k], bucket)


def ivf_prompt_search(
    spark: SparkSession,
    by_video: str | Clustered,
    by_text: str | Clustered,
    query: Sequence[float],
    branch_k: int = PROMPT_BRANCH_RESULTS,
    k: int = PROMPT_RESULTS,
    nprobe: int | None = None,
) -> DataFrame:
    """Approximate ``prompt_search`` on two clustered tables of the prompts, one per vector column."""
    video_rows, text_rows = (ivf_candidates(spark, p, query, nprobe) for p in (by_video, by_text))
    return prompt_search(video_rows, query, branch_k, k, by_text=text_rows)


def _asked(table: Clustered, queries: DataFrame, probes: int, query_id: str, query_vec: str, query_cut: str | None = None) -> DataFrame:
    """The queries, stored, with the ``cells`` that each looks into: those of its nearest centroids."""
    kept = written(queries.select(query_id, query_vec, *([query_cut] if query_cut else [])), "queries")
    near = knn_join(
        _centroids(table).select("cell", "centre"), kept, probes, base_col="centre", query_id=query_id, query_vec=query_vec, order=("cell",)
    )
    cells = near.groupBy(query_id).agg(F.collect_list("cell").alias("cells"))  # ``probes`` numbers
    return written(kept.join(cells, query_id, "left"), "queries")


def ivf_search_batch(
    spark: SparkSession,
    path: str | Clustered,
    queries: DataFrame,
    k: int = SCENE_RESULTS,
    nprobe: int | None = None,
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
    order: tuple[str, ...] = SCENE_ORDER,
    key: list[str] | None = None,
) -> DataFrame:
    """Approximate nearest-neighbour join: each row is scored for the queries that probe its cell."""
    table = _opened(spark, path)
    rows = _rows(table, key == ROW_PLACE).drop("norm", "toward")
    common = dict(base_col=table.about.vec_col, query_id=query_id, query_vec=query_vec, order=order, key=key)
    probes = _probes(table, nprobe)
    if probes is None:
        return knn_join(rows.drop("cell", "coarse"), queries, k, **common)
    asked = _asked(table, queries, probes, query_id, query_vec)
    return knn_join(rows, asked, k, query_cells="cells", **_by_cell(table), **common)


def _by_cell(table: Clustered) -> dict:
    """For ``knn_join``: which columns say where rows lie, and how some cells are read."""
    return dict(cell_col="cell", layout=("coarse",), cell_rows=_of_cells(table))


def ivf_search_batch_exact(
    spark: SparkSession,
    path: str | Clustered,
    queries: DataFrame,
    k: int = SCENE_RESULTS,
    nprobe: int | None = None,
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
    order: tuple[str, ...] = SCENE_ORDER,
    key: list[str] | None = None,
    columns: list[str] | None = None,
    query_cut: str | None = None,
    closeness: bool = False,
) -> DataFrame:
    """The exact nearest-neighbour join: a first search of the nearest cells, and a second of those that may hold more.

    The second search opens for each query the cells whose bound reaches its k-th best row of the first. ``columns``
    are those of a row to return, all unless given. ``query_cut`` and ``closeness`` are as in ``knn_join``. Where the build has
    measured that the nearest rows lie in many of the cells, all rows are searched at once, unless ``nprobe`` is given.
    """
    table = _opened(spark, path)
    rows = _rows(table, key == ROW_PLACE).drop("norm", "toward")
    rows = rows if columns is None else rows.select(*columns, table.about.vec_col, "cell", "coarse")
    common = dict(base_col=table.about.vec_col, query_id=query_id, query_vec=query_vec, order=order, key=key, query_cut=query_cut)
    probes = _probes(table, nprobe)
    if probes is None or (nprobe is None and probes * _WORTHWHILE > table.about.n_cells):
        return knn_join(rows.drop("cell", "coarse"), queries, k, closeness=closeness, **common)
    asked = _asked(table, queries, probes, query_id, query_vec, query_cut)
    by_cell = _by_cell(table) | {"query_cells": "cells", "closeness": True}
    first = written(knn_join(rows, asked, k, **by_cell, **common), "winners")
    kth = first.filter(F.col("rank") == k).select(F.col(query_id).alias("_id"), F.col("_close").alias("_kth"))
    cut = F.greatest("_kth", F.lit(None).cast("double") if query_cut is None else query_cut)
    known = asked.join(kth, asked[query_id].eqNullSafe(kth["_id"]), "left").select(query_id, query_vec, "cells", cut.alias("cut"))
    open_cells = written(_reaching_cells(table, known, query_id, query_vec), "queries")
    more = knn_join(rows.filter(F.col("cell") >= 0), open_cells, k, **by_cell, **(common | {"query_cut": "cut"}))
    best = Window.partitionBy(query_id).orderBy(F.desc("_close"), *order)
    both = first.unionByName(more.select(*first.columns)).withColumn("rank", F.row_number().over(best).cast("bigint"))
    found = both.filter(F.col("rank") <= k)
    return found if closeness else found.drop("_close")


def ivf_prompt_search_batch(
    spark: SparkSession,
    by_video: str | Clustered,
    by_text: str | Clustered,
    queries: DataFrame,
    branch_k: int = PROMPT_BRANCH_RESULTS,
    k: int = PROMPT_RESULTS,
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
) -> DataFrame:
    """``prompt_search_batch``, exact, on two clustered tables of the prompts, one per vector column.

    What the k-th best prompt by video vector reaches is what a text vector has to reach, so the second table is
    opened only where that is possible.
    """
    kept = written(queries.select(query_id, query_vec), "queries")
    common = dict(query_id=query_id, query_vec=query_vec, order=("id",), columns=PROMPT_COLUMNS, closeness=True)
    videos = written(ivf_search_batch_exact(spark, by_video, kept, branch_k, **common), "winners")
    reached = videos.filter(F.col("rank") == k).select(F.col(query_id).alias("_id"), F.col("_close").alias("cut"))
    known = kept.join(reached, kept[query_id].eqNullSafe(reached["_id"]), "left").drop("_id")
    texts = ivf_search_batch_exact(spark, by_text, known, branch_k, query_cut="cut", **common)
    return best_prompts(videos.unionByName(texts.select(*videos.columns)), k, query_id)


def _reaching_cells(table: Clustered, known: DataFrame, query_id: str, query_vec: str) -> DataFrame:
    """The queries with their ``cut`` and, as ``cells``, those that may hold a row as close as that and were not among ``cells``.

    Blocks of queries and chunks of centroids meet in tasks; neither passes the driver.
    """
    dims, id_field = table.about.dims, known.schema[query_id]
    cells = ivf_reach(table).join(_centroids(table), "cell").select("cell", "toward", "centre")
    asked = known.select(F.col(query_id).alias("id"), F.col(query_vec).cast("array<double>").alias("v"), "cut", "cells").filter(usable(F.col("v"), dims))
    n_blocks = int(max(1, -(-asked.count() * dims * 8 // QUERY_BLOCK_BYTES)))
    schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("found", T.ArrayType(T.IntegerType()))])
    nothing = table.spark.createDataFrame([], schema).toArrow()

    def task(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return nothing
        vectors = levels.unit(levels.rows_of(block.column("v").combine_chunks(), dims))
        centres = levels.rows_of(some.column("centre").combine_chunks(), dims)
        numbers, wide = some.column("cell").to_numpy(), np.arccos(np.clip(some.column("toward").to_numpy(), -1, 1))
        found, cuts = [], block.column("cut").to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = np.nan_to_num(cuts, nan=-np.inf)
        for at in range(0, len(vectors), 256):
            part = vectors[at : at + 256]
            apart = np.arccos(np.clip(part @ centres.T, -1, 1)) - wide - _ANGLE_SLACK
            bound = np.where(apart <= 0, 1.0, np.cos(np.maximum(apart, 0)))
            # A query without a direction is as close to any row as to any other.
            bound[~part.any(axis=1)] = 0.0
            near = bound >= cuts[at : at + 256, None]
            for i in range(len(part)):
                found.append(np.setdiff1d(numbers[near[i]], block.column("cells")[at + i].as_py() or []).astype(np.int32))
        return pa.table({"id": block.column("id"), "found": pa.array(found, pa.list_(pa.int32()))})

    met = deal(cells, chunks_of(table.about.n_cells, dims), asked, n_blocks).applyInArrow(task, schema)
    lists = met.groupBy(F.col("id").alias("_id")).agg(F.flatten(F.collect_list("found")).alias("found"))  # at most all cells
    joined = known.drop("cells").join(lists, known[query_id].eqNullSafe(lists["_id"]), "left")
    return joined.select(query_id, query_vec, "cut", F.col("found").alias("cells")).filter(F.size("cells") > 0)


def ivf_recall(exact: DataFrame, approximate: DataFrame, key: list[str], query_id: str = "query_id") -> DataFrame:
    """Share of each query's exact neighbours that the approximate search found."""
    found = approximate.select(query_id, *key).withColumn("hit", F.lit(1))
    wanted = exact.select(query_id, *key)
    return (
        wanted.join(found, [query_id, *key], "left")
        .groupBy(query_id)
        .agg((F.count("hit") / F.count("*")).alias("recall"))
    )
