"""Vectors and queries dealt into cells of bounded size, in each of which some rows meet some queries.

The table and the queries are cut into shards and blocks of about ``ROW_CELL`` and ``QUERY_CELL`` components. Each
shard meets each block in one group of a shuffle, so no task and not the driver holds more than a cell, however many
rows or queries there are, and a lost executor only costs its own cells. Rows are dealt by their place in the input, not
by a key, so equal rows and rows of one label spread over all shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components of the rows and of the queries of a cell: 8,192 and 4,096 vectors of 64.
ROW_CELL, QUERY_CELL = 1 << 19, 1 << 18
_KEY = ["_dims", "_shard", "_block"]
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


def scaled(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down, as a double; exact for any size."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)


def taking_part(vector: Column, scale: int) -> Column:
    """True for a vector that is there and has finite components only, also when scaled; NULL or false otherwise."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(float("inf"))))


def _count(table: DataFrame, cell: int) -> int:
    components = table.agg(F.sum(F.greatest(F.size("v"), F.lit(1)).cast("long"))).first()[0]
    return max(1, -(-(components or 0) // cell))


def deal_rows(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both tables, of which ``v`` is the vector, with the cells that their rows go to, and the number of shards.

    Queries need a ``query_id`` and have no shard yet; see ``in_shards``.
    """
    n_shards, n_blocks = _count(rows, ROW_CELL), _count(queries, QUERY_CELL)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_shards)).cast("int")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    dealt = rows.withColumn("_dims", F.size("v")).withColumn("_shard", place).withColumn("_block", blocks)
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")
    return dealt, queries.withColumn("_dims", F.size("v")).withColumn("_block", block), n_shards


def in_shards(queries: DataFrame, n_shards: int) -> DataFrame:
    """The queries once for each of the first ``n_shards`` shards."""
    return queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))


def meet(dealt: DataFrame, asked: DataFrame, cell: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``cell(rows, queries)`` gives for every cell. Vectors meet those of their own length only."""

    def task(rows: pa.Table, queries: pa.Table) -> pa.Table:
        return cell(rows, queries)

    return dealt.groupBy(*_KEY).cogroup(asked.groupBy(*_KEY)).applyInArrow(task, schema)


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    """The vectors of a cell, all of one length, as rows of doubles."""
    lists = table.column(column).combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0))


def exact(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are if no inner product of theirs can be rounded, otherwise as Python's integers, which are exact."""
    most = [float(np.abs(m).max()) if m.size else 0.0 for m in (left, right)]
    if most[0] * most[1] * max(1, left.shape[-1]) < _EXACT:
        return left, right
    whole = np.frompyfunc(int, 1, 1)
    return whole(left).astype(object), whole(right).astype(object)


def within_long(scores: np.ndarray) -> np.ndarray:
    """Scores; those beyond the range of a long are its nearest end. Only Python's integers can be."""
    return np.minimum(np.maximum(scores, -_LONG - 1), _LONG) if scores.dtype == object else scores


def kth_best(scores: np.ndarray, k: int) -> float:
    """What the k-th best of all rows reaches at least, seen from some: minus infinity if that says nothing."""
    if len(scores) < k:
        return -np.inf
    at = len(scores) - k
    value = np.sort(within_long(scores))[at] if scores.dtype == object else np.partition(scores, at)[at]
    return value if value > -_LONG - 1 else -np.inf


def as_longs(scores: list) -> pa.Array:
    return pa.array([int(s) for s in scores], pa.int64())
