"""Exact nearest-neighbour join of a query table with a table of vectors.

Every task scores its rows against blocks of queries with one matrix product per block of rows and keeps
only the best k rows of each query, so a task never emits more than k rows per query. The rows that
remain are ranked by Spark in two steps. For few queries the vectors of the table are not shuffled; for many,
the rows of one vector are gathered first, so that each different vector is scored once in the whole table.

Rows are ranked by closeness and then by the columns named, in the tasks and after them alike; the distance
that is shown is worked out last.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps as GroupedPair

from clipatlas.functions.vectors import usable
from clipatlas.operators.blocks import QueryBlock, TaskTopK, probed_pairs, row_blocks, to_matrix
from clipatlas.workdir import work_folder

SCENE_ORDER = ("video_id", "timestamp_start", "title")
QUERY_BLOCK_BYTES = 64 << 20
_RANK_SLOTS = 64
# What a found row is taken to need for each of its columns while it waits in a task.
_COLUMN_BYTES = 64
# Vectors of a chunk of rows that meets one block after the other, each in a task of its own.
ROW_CHUNK_BYTES = 64 << 20
# With more cores than this, some rows are searched first, which bounds what the many tasks emit.
BOUND_FROM_CORES, BOUND_ROWS = 256, 50_000
# From so many queries on, scoring a row costs more than shuffling it, and rows are gathered by vector if on average
# so many or more share one. Not for a larger k, since up to k rows of a vector are kept beside it.
GATHER_FROM, GATHER_COPIES, GATHER_MOST = 4096, 2, 64

# The function the tasks run is defined here; it goes to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _task_schema(base: DataFrame, hidden: set[str | None], id_field: T.StructField) -> T.StructType:
    fields = [f for f in base.schema.fields if f.name not in hidden]
    return T.StructType([*fields, T.StructField("_close", T.DoubleType()), T.StructField("_query", id_field.dataType)])


def _score(
    base: DataFrame,
    block: QueryBlock,
    k: int,
    metric: str,
    vec_col: str,
    order: list[str],
    id_field: T.StructField,
    cell_col: str | None,
) -> DataFrame:
    """The best k rows of every task for every query of one block, which is sent to all tasks."""
    shared = base.sparkSession.sparkContext.broadcast(tuple(block))
    dims = block.vectors.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = TaskTopK(QueryBlock(*shared.value), k, metric, vec_col, order, cell_col)
        for table in row_blocks(batches, vec_col, dims):
            top.add(table)
        yield from _emitted(top)

    return base.filter(usable(F.col(vec_col), dims)).mapInArrow(task, _task_schema(base, {vec_col, cell_col}, id_field))


def _emitted(top: TaskTopK) -> Iterator[pa.RecordBatch]:
    result = top.result()
    if result is not None:
        yield from result.to_batches(max_chunksize=10_000)


def _block_of(queries: pa.Table, dims: int) -> QueryBlock:
    """Queries ``id, v, cut`` and, for a clustered table, ``cells``, without those whose vector has NULL numbers."""
    vectors, whole = to_matrix(queries.column("v").combine_chunks(), dims)
    if not whole.all():
        queries, vectors = queries.filter(pa.array(whole)), vectors[whole]
    probed = probed_pairs(queries.column("cells").combine_chunks()) if "cells" in queries.column_names else None
    return QueryBlock(queries.column("id").combine_chunks(), vectors, probed, queries.column("cut").to_numpy().copy())


def deal(rows: DataFrame, n_chunks: int, queries: DataFrame, n_blocks: int, query_id: str = "id") -> GroupedPair:
    """Chunks of rows and blocks of queries by a shuffle, so that each pair of them is one group of a task.

    Rows are dealt by their place in the input, so that equal rows spread; queries by their id.
    """
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_chunks)).cast("int")
    block = F.pmod(F.xxhash64(query_id), F.lit(n_blocks)).cast("int")
    blocks, chunks = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_blocks, n_chunks))
    dealt = rows.withColumn("_chunk", chunk).withColumn("_block", blocks)
    asked = queries.withColumn("_block", block).withColumn("_chunk", chunks)
    return dealt.groupBy("_chunk", "_block").cogroup(asked.groupBy("_chunk", "_block"))


def chunks_of(n_rows: int, dims: int) -> int:
    return int(max(1, -(-n_rows * dims * 8 // ROW_CHUNK_BYTES)))


def _gathered(rows: DataFrame, k: int, vec_col: str, order: list[str], travel: list[str], cell_col: str | None, dims: int) -> DataFrame | None:
    """A stored table with one row for each different vector of a cell, or None if few rows share one.

    ``_rows`` holds the first k rows of the vector in ``order``; no others can be among the best k of a query. ``_no`` numbers the vectors,
    which are told apart by two hashes of 64 bits. Every task of the scan keeps at most k rows of a vector before the shuffle, so a hot
    vector is no hot task.
    """
    hashes = {"_hash": F.xxhash64(vec_col), "_other": F.xxhash64(F.lit(GATHER_FROM), vec_col)}
    held = rows.filter(usable(F.col(vec_col), dims)).withColumns(hashes)
    copies = held.agg((F.count("*") >= F.lit(GATHER_COPIES) * F.approx_count_distinct("_hash")).alias("many")).first()
    if not copies.many:
        return None
    same = [*hashes, *([cell_col] if cell_col else [])]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    first = held.withColumn("_nth", place).filter(F.col("_nth") <= k)
    listed = F.sort_array(F.collect_list(F.struct("_nth", *travel))).alias("_rows")  # at most k
    nested = first.groupBy(*same).agg(F.any_value(vec_col).alias(vec_col), listed)
    return written(nested.drop(*hashes).withColumn("_no", F.monotonically_increasing_id()), "vectors")


def _leading(vectors: DataFrame, vec_col: str, order: list[str], cell_col: str | None) -> DataFrame:
    """The vectors of a gathered table to score, each with what ranks its first row."""
    first = F.get("_rows", F.lit(0))
    return vectors.select("_no", *[first[c].alias(c) for c in order], vec_col, *([cell_col] if cell_col else []))


def _spread_out(scored: DataFrame, vectors: DataFrame, k: int, order: list[str], travel: list[str]) -> DataFrame:
    """From the scored vectors the rows to rank. The best k rows of a query are rows of its best k vectors by their first rows."""
    best = _rank(scored, k, order).select("_query", "_close", F.col("_no").alias("_of"))
    rows = vectors.select("_no", F.inline("_rows")).select("_no", *travel)
    return best.join(rows, best["_of"] == rows["_no"]).select(*travel, "_close", "_query")


def _score_dealt(
    base: DataFrame,
    queries: DataFrame,
    n_blocks: int,
    dims: int,
    k: int,
    metric: str,
    vec_col: str,
    order: list[str],
    id_field: T.StructField,
    cell_col: str | None,
    part: int,
) -> DataFrame:
    """As ``_score`` for many blocks. A task holds one chunk of rows and one block of queries, of which it scores ``part`` at a time."""
    schema = _task_schema(base, {vec_col, cell_col}, id_field)
    rows = base.filter(usable(F.col(vec_col), dims))
    names, nothing = schema.fieldNames(), base.sparkSession.createDataFrame([], schema).toArrow()

    def task(some: pa.Table, block: pa.Table) -> pa.Table:
        if not some.num_rows or not block.num_rows:
            return nothing
        rows, found = some.drop_columns(["_chunk", "_block"]), []
        for at in range(0, block.num_rows, part):
            top = TaskTopK(_block_of(block.slice(at, part), dims), k, metric, vec_col, order, cell_col)
            for table in row_blocks(iter(rows.to_batches(max_chunksize=10_000)), vec_col, dims):
                top.add(table)
            result = top.result()
            if result is not None:
                found.append(result.select(names))
        return pa.concat_tables(found) if found else nothing

    # A group for each core at least, also where few blocks and chunks hold everything.
    n_chunks = max(chunks_of(rows.count(), dims), -(-base.sparkSession.sparkContext.defaultParallelism // n_blocks))
    return deal(rows, n_chunks, queries, n_blocks).applyInArrow(task, schema)


def _rank(scored: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Best k per query. A first round per group of tasks keeps the last one small."""
    by = [F.desc("_close"), *[F.asc(c) for c in order]]
    slot = F.pmod(F.spark_partition_id(), F.lit(_RANK_SLOTS))
    partial = scored.withColumn("_slot", slot).withColumn(
        "rank", F.row_number().over(Window.partitionBy("_query", "_slot").orderBy(*by))
    )
    final = Window.partitionBy("_query").orderBy(*by)
    return (
        partial.filter(F.col("rank") <= k)
        .drop("_slot")
        .withColumn("rank", F.row_number().over(final).cast("bigint"))
        .filter(F.col("rank") <= k)
    )


def nearest(
    rows: DataFrame,
    query: Sequence[float],
    k: int,
    metric: str = "cosine",
    vec_col: str = "embedding",
    order: tuple[str, ...] = SCENE_ORDER,
    closeness: bool = False,
) -> DataFrame:
    """The ``k`` rows nearest to one vector, best first, with their ``distance`` and without the vector.

    The vector travels with the job; no table of queries is read. ``closeness`` keeps ``_close``, the number
    that the rows are ranked by.
    """
    _check_metric(metric)
    block = QueryBlock(pa.array([0], pa.int32()), np.array([query], dtype=np.float64))
    typed = rows.withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    scored = _score(typed, block, k, metric, vec_col, list(order), T.StructField("_query", T.IntegerType()), None)
    # The distance is worked out below the sort: above it, it would keep Spark from taking the top k.
    shown = scored.drop("_query").withColumn("distance", distance_of("_close", metric))
    found = shown.orderBy(F.desc("_close"), *order).limit(k)
    return found if closeness else found.drop("_close")


def nearest_each(
    rows: DataFrame, ids: list[int], vectors: np.ndarray, k: int, vec_col: str, order: tuple[str, ...]
) -> DataFrame:
    """``query_id``, ``rank`` and the ``k`` rows nearest, by cosine, to each of a few vectors that travel with the job."""
    typed = rows.withColumn(vec_col, F.col(vec_col).cast("array<double>"))
    block = QueryBlock(pa.array(ids, pa.int64()), vectors)
    scored = _score(typed, block, k, "cosine", vec_col, list(order), T.StructField("_query", T.LongType()), None)
    return _rank(scored, k, list(order)).withColumnRenamed("_query", "query_id").drop("_close")


def distance_of(close: str, metric: str = "cosine") -> Column:
    return F.lit(1.0) - F.col(close) if metric == "cosine" else -F.col(close)


def _check_metric(metric: str) -> None:
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a stored table: computed once, and of a size Spark knows before it plans a join."""
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _winners(
    narrow_of: Callable[[list[int] | None], DataFrame],
    queries: DataFrame,
    k: int,
    metric: str,
    base_col: str,
    query_id: str,
    query_vec: str,
    order: list[str],
    travel: list[str],
    block_bytes: int,
    cell_col: str | None,
    query_cells: str | None,
    query_cut: str | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Ranked rows ``_query, rank, _close`` and the travelling columns. ``bounded``: they are themselves a bound.

    ``narrow_of`` gives the rows to score, of some cells or all.
    """
    narrow = narrow_of(None)
    id_field = queries.schema[query_id]
    vec = F.col(query_vec).cast("array<double>")
    # Kept while it is read, since the vectors may come from a model.
    probing = [] if query_cells is None else [F.coalesce(query_cells, F.array().cast("array<int>")).alias("cells")]
    lowest = F.lit(float("-inf"))
    cut = lowest if query_cut is None else F.coalesce(query_cut, lowest)
    kept = queries.select(F.col(query_id).alias("id"), vec.alias("v"), cut.alias("cut"), *probing).persist()
    try:
        usable_queries = kept.filter(usable(F.col("v")))
        facts = usable_queries.agg(
            F.count("*").alias("n"), F.countDistinct("id").alias("ids"),
            F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dims"),
            (F.sum(F.size("cells")) if probing else F.lit(0)).alias("pairs"),
        ).first()
        if not facts.n:
            return narrow.select(*travel).limit(0).select(
                "*", F.lit(0.0).alias("_close"), F.lit(None).cast(id_field.dataType).alias("_query"),
                F.lit(0).cast("bigint").alias("rank"),
            )
        if facts.least != facts.dims:
            raise ValueError("query vectors differ in length")
        if facts.ids != facts.n:
            raise ValueError("query ids are not unique")

        cuts = usable_queries
        if not bounded and narrow.sparkSession.sparkContext.defaultParallelism > BOUND_FROM_CORES:
            some = _winners(
                lambda _: narrow.limit(BOUND_ROWS), kept, k, metric, base_col, "id", "v", order, travel, block_bytes, cell_col, query_cells and "cells", None, True
            )
            least = some.filter(F.col("rank") == k).select(F.col("_query").alias("id"), F.col("_close").alias("least"))
            cuts = usable_queries.join(least, "id", "left").withColumn("cut", F.greatest("cut", F.coalesce("least", lowest))).drop("least")

        size = facts.n * (facts.dims * 8 + k * _COLUMN_BYTES * len(travel)) + 4 * facts.pairs
        many = facts.n >= GATHER_FROM and k <= GATHER_MOST
        vectors = None
        if size <= block_bytes:
            block = _block_of(cuts.toArrow(), facts.dims)  # at most block_bytes
            # Reads the cells some query looks into, and the rows outside the cells.
            rows = narrow_of(np.unique(block.probed[0]).tolist()) if probing else narrow
            vectors = _gathered(rows, k, base_col, order, travel, cell_col, facts.dims) if many else None
            rows = rows if vectors is None else _leading(vectors, base_col, order, cell_col)
            scored = _score(rows, block, k, metric, base_col, order, id_field, cell_col)
        else:
            # A task gets as many queries as it can hold, however few it scores at a time: every further block is a copy of all rows.
            # Half full on average, so that an uneven hash does not pass the limit.
            n_blocks = int(-(-2 * size // max(block_bytes, QUERY_BLOCK_BYTES)))
            part = int(max(1, block_bytes * facts.n // size))
            vectors = _gathered(narrow, k, base_col, order, travel, cell_col, facts.dims) if many else None
            rows = narrow if vectors is None else _leading(vectors, base_col, order, cell_col)
            # Stored, since the vectors may come from a model and ``kept`` goes.
            asked = written(cuts, "queries")
            scored = _score_dealt(rows, asked, n_blocks, facts.dims, k, metric, base_col, order, id_field, cell_col, part)
    finally:
        kept.unpersist()
    return _rank(scored if vectors is None else _spread_out(scored, vectors, k, order, travel), k, order)


def knn_join(
    base: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str = "cosine",
    *,
    base_col: str = "embedding",
    query_id: str = "query_id",
    query_vec: str = "query_embedding",
    order: tuple[str, ...] = SCENE_ORDER,
    key: list[str] | None = None,
    block_bytes: int = QUERY_BLOCK_BYTES,
    cell_col: str | None = None,
    query_cells: str | None = None,
    query_cut: str | None = None,
    cell_rows: Callable[[DataFrame, list[int]], DataFrame] | None = None,
    layout: tuple[str, ...] = (),
    closeness: bool = False,
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` for every query: ``query_id, rank, distance`` and the row.

    Equal closeness is ranked by ``order``. ``key`` names columns that identify a base row: then only these
    and ``order`` travel with the vectors; the winners are written to the work folder and the other columns
    joined to them, by broadcast if the written table is small, from the cells of the winners if there are
    cells. Queries up to ``block_bytes``, with what their results need in a task, are sent to all tasks; more
    are dealt into blocks, each of which meets each chunk of ``base`` in one task of a shuffle, so none of them
    pass the driver. ``query_cells`` names a column of ``queries`` with the cells that a query looks into, among
    those in ``cell_col`` (see ``ivf``), and ``query_cut`` one with a closeness below which nothing is
    wanted. ``cell_rows`` restricts ``base`` to some cells and the rows outside them, by columns that only say where
    rows lie if need be; these are ``layout``. ``closeness`` keeps ``_close``, the number that the rows are ranked by.
    """
    _check_metric(metric)
    hidden = [c for c in (base_col, cell_col, *layout) if c]
    cell_rows = cell_rows or (lambda rows, cells: rows.filter(F.col(cell_col).isin(cells) | (F.col(cell_col) < 0)))
    payload = [c for c in base.columns if c not in hidden]
    travel = payload if key is None else list(dict.fromkeys([*key, *order]))
    vectors = F.col(base_col).cast("array<double>").alias(base_col)
    others = [] if key is None else [c for c in payload if c not in travel]
    placed = [F.col(cell_col).alias("_cell")] if cell_col and others else []

    def narrow_of(cells: list[int] | None) -> DataFrame:
        rows = base if cells is None else cell_rows(base, cells)
        return rows.select(*travel, *placed, vectors, *([cell_col] if cell_col else []))

    travelling = [*travel, *(["_cell"] if placed else [])]
    winners = _winners(
        narrow_of, queries, k, metric, base_col, query_id, query_vec, list(order), travelling, block_bytes, cell_col, query_cells, query_cut
    )

    shown = ["_close"] if closeness else []
    hits = winners.select(F.col("_query").alias(query_id), "rank", distance_of("_close", metric).alias("distance"), *shown, *travelling)
    if not others:
        return hits
    hits = written(hits, "winners")
    rows = base
    if placed:
        # At most as many numbers as there are cells; the other folders are not read again.
        cells = [r["_cell"] for r in hits.select("_cell").distinct().collect()]
        rows = cell_rows(base, cells)
    rows = rows.select(*[F.col(c).alias(f"_k_{c}") for c in key], *others)
    same = [hits[c].eqNullSafe(rows[f"_k_{c}"]) for c in key]
    return hits.join(rows, same).select(query_id, "rank", "distance", *shown, *payload)
