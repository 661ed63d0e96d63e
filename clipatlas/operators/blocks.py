"""What one task does in a nearest-neighbour search: score blocks of its rows, keep the best few."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

ROW_BLOCK_BYTES = 32 << 20
_SCORE_BLOCK = 1 << 22
_PAIR_BLOCK_BYTES = 64 << 20
_CUT_ROWS = 4096
_FEW_QUERIES = 64

# Tasks get the code of this module with the job, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class QueryBlock(NamedTuple):
    """Query vectors of bounded size, as every task receives them."""

    ids: pa.Array
    vectors: np.ndarray
    # For a clustered table: pairs of a cell and the place of a query that looks into it, by cell.
    probed: tuple[np.ndarray, np.ndarray] | None = None
    # For each query a closeness that its k-th best row reaches for sure.
    cuts: np.ndarray | None = None


def probed_pairs(cells: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """From the cells of each query the pairs that a ``QueryBlock`` keeps."""
    lengths = cells.value_lengths().fill_null(0).to_numpy()
    of_query, cell = np.repeat(np.arange(len(lengths)), lengths), cells.flatten().to_numpy()
    order = np.argsort(cell, kind="stable")
    return cell[order], of_query[order]


def to_matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column as a matrix, and a mask of the rows without NULL elements."""
    flat = column.flatten()
    matrix = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)
    if flat.null_count == 0:
        return matrix, np.ones(len(matrix), dtype=bool)
    missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return matrix, ~missing.any(axis=1)


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def _units(m: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zeros for rows without a direction."""
    with np.errstate(all="ignore"):
        return np.nan_to_num(m / norms[:, None], nan=0.0, posinf=0.0, neginf=0.0)


def _digests(m: np.ndarray) -> np.ndarray:
    """A number per row that is equal for equal rows, by wrapping integer arithmetic."""
    factors = np.random.default_rng(1).integers(1, 2**63, size=m.shape[1], dtype=np.uint64) | np.uint64(1)
    return (np.ascontiguousarray(m).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64)


def _distinct(rows, digest, members, k):
    """Distinct vectors among ``members``, which come in tie order.

    Gives the first row of each vector, the first k rows of each one after the other, and how many
    these are. Rows of one vector score alike, so no more than the first k can be among the best.
    """
    _, first, group = np.unique(digest[members], return_index=True, return_inverse=True)
    alone = len(first) == len(members)
    if not alone and not np.array_equal(rows[members], rows[members[first]][group], equal_nan=True):
        alone = True  # Two different vectors share a digest; treat all as distinct.
    if alone:
        return members, members, np.ones(len(members), dtype=np.int64)
    by = np.argsort(group, kind="stable")
    sizes = np.bincount(group)
    rank = np.arange(len(by)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return members[first], members[by[rank < k]], np.minimum(sizes, k)


def _expand(query, which, close, copies, counts):
    """Replace each distinct vector by its rows."""
    n = counts[which]
    starts = (np.cumsum(counts) - counts)[which]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(query, n), copies[np.repeat(starts, n) + within], np.repeat(close, n)


class _Scorer:
    """Closeness of rows to queries: cosine similarity, or the negated euclidean distance.

    A matrix product tells cheaply which rows may be among the best. It is off by no more than a
    known slack, and the rows it lets through are scored again by ``exact``.
    """

    def __init__(self, queries: np.ndarray, metric: str):
        self.queries, self.metric = queries, metric
        self.norms = _norms(queries)
        dims = queries.shape[1]
        if metric == "cosine":
            # Single precision over unit vectors, with twice the usual bound on the rounding.
            self.right = _units(queries, self.norms).astype(np.float32)
            self.slack = (dims + 8) * 2.0**-23
        else:
            # |x - q|^2 = |x|^2 + |q|^2 - 2xq, with |x|^2 as one more dimension of x.
            self.right = np.c_[queries, np.ones(len(queries))]
            self.slack = (dims + 8) * 2.0**-50

    def left(self, rows: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Rows as the matrix product takes them."""
        if self.metric == "cosine":
            return _units(rows, norms).astype(np.float32)
        with np.errstate(all="ignore"):
            return np.c_[2 * rows, -(1 - self.slack) * norms * norms]

    def may_reach(self, left: np.ndarray, part: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """For each row and query of ``part``, whether the closeness may be at least ``cut``."""
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                need = (cut - self.slack).astype(np.float32)
            else:
                size = self.norms[part] ** 2
                need = -cut * cut * (1 + self.slack) + (1 - self.slack) * size
            # Written so that a product that is no number passes.
            return ~(left @ self.right[part].T < need[None, :])

    def at_least(self, left: np.ndarray, part: np.ndarray, k: int) -> np.ndarray:
        """For each query of ``part``, a closeness that at least k of the rows reach."""
        if len(left) < k:
            return np.full(len(part), -np.inf)
        with np.errstate(all="ignore"):
            low = (left @ self.right[part].T).astype(np.float64)
            if self.metric == "cosine":
                low -= self.slack
            else:
                sizes = -left[:, -1:] / (1 - self.slack) + (self.norms[part] ** 2)[None, :]
                low = low - (self.norms[part] ** 2)[None, :] - 2 * self.slack * sizes
                low = -np.sqrt(np.maximum(-low, 0))
            low = np.nan_to_num(low, nan=-np.inf, neginf=-np.inf)
            return np.partition(low, len(low) - k, axis=0)[len(low) - k]

    def exact(self, rows: np.ndarray, norms: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Closeness of row i to query i. Depends on the two vectors only, so equal vectors tie."""
        q = self.queries[queries]
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                scale = norms * self.norms[queries]
                return np.nan_to_num(np.where(scale > 0, (rows * q).sum(axis=1) / scale, 0.0), nan=0.0)
            return np.nan_to_num(-_norms(rows - q), nan=-np.inf)


def _first_k(query: np.ndarray, close: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k entries of each query, by closeness and then by ``tie``."""
    if not len(query):
        return np.arange(0)
    order = np.lexsort((tie, -close, query))
    ranked = query[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    rank = np.arange(len(ranked)) - np.repeat(starts, np.diff(np.r_[starts, len(ranked)]))
    return order[rank < k]


def _positions(table: pa.Table, order: list[str]) -> np.ndarray:
    """Place of each row when sorted by ``order``, NULL first as in Spark."""
    if not order:
        return np.arange(table.num_rows)
    keys = [(name, "ascending") for name in order]
    by = pc.sort_indices(table, sort_keys=keys, null_placement="at_start").to_numpy()
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    return place


class TaskTopK:
    """The best k rows per query seen so far in one task."""

    def __init__(self, block: QueryBlock, k: int, metric: str, vec_col: str, order: list[str], cell_col: str | None):
        self.block, self.k, self.vec_col, self.order, self.cell_col = block, k, vec_col, order, cell_col
        self.scorer = _Scorer(block.vectors, metric)
        self.best: pa.Table | None = None
        # Closeness of the k-th best row of each query so far.
        self.cut = np.full(len(block.vectors), -np.inf) if block.cuts is None else block.cuts.copy()

    def add(self, table: pa.Table) -> None:
        rows, whole = to_matrix(table.column(self.vec_col).combine_chunks(), self.block.vectors.shape[1])
        if not whole.all():
            table, rows = table.filter(pa.array(whole)), rows[whole]
        norms = _norms(rows)
        if self.cell_col is None and len(self.cut) <= _FEW_QUERIES and len(rows):
            # For few queries most rows can be left out before any is sorted.
            part, left = np.arange(len(self.cut)), self.scorer.left(rows, norms)
            near = self.scorer.may_reach(left, part, self._cut_for(left, part)).any(axis=1)
            table, rows, norms = table.filter(pa.array(near)), rows[near], norms[near]
        tie, digest = _positions(table, self.order), _digests(rows)
        found = []
        for members, queries in self._units(table):
            if not len(members) or not len(queries):
                continue
            members = members[np.argsort(tie[members])]
            distinct, copies, counts = _distinct(rows, digest, members, self.k)
            left = self.scorer.left(rows[distinct], norms[distinct])
            width = max(1, _SCORE_BLOCK // len(distinct))
            for at in range(0, len(queries), width):
                part = queries[at : at + width]
                query, which, close = self._best_of(rows, norms, tie, distinct, left, part)
                query, row, close = _expand(query, which, close, copies, counts)
                keep = _first_k(query, close, tie[row], self.k)
                found.append((query[keep], row[keep], close[keep]))
                self._raise_cut(query[keep], close[keep])
        if found:
            query, row, close = (np.concatenate(x) for x in zip(*found))
            keep = _first_k(query, close, tie[row], self.k)
            self._merge(table, query[keep], row[keep], close[keep])

    def _units(self, table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and the queries they are scored against: all with all, or cell by cell."""
        every = np.arange(len(self.block.vectors))
        if self.cell_col is None:
            yield np.arange(table.num_rows), every
            return
        cell = table.column(self.cell_col).to_numpy()
        cells, queries = self.block.probed
        order = np.argsort(cell, kind="stable")
        values, starts = np.unique(cell[order], return_index=True)
        for value, members in zip(values, np.split(order, starts[1:]), strict=True):
            # Rows outside the cells, with a negative number, are scored for all queries.
            begin, end = np.searchsorted(cells, (value, value + 1))
            yield members, every if value < 0 else queries[begin:end]

    def _best_of(self, rows, norms, tie, distinct, left, part):
        """The best k of the distinct vectors for each query: query, place in ``distinct``, closeness."""
        # Found in the flat matrix, which takes a fraction of the time of a search by rows and columns.
        which, col = np.divmod(np.flatnonzero(self.scorer.may_reach(left, part, self._cut_for(left, part))), len(part))
        query, row = part[col], distinct[which]
        exact = np.empty(len(row))
        step = max(1, _PAIR_BLOCK_BYTES // (8 * rows.shape[1]))
        for at in range(0, len(row), step):
            r, q = row[at : at + step], query[at : at + step]
            exact[at : at + step] = self.scorer.exact(rows[r], norms[r], q)
        keep = _first_k(query, exact, tie[row], self.k)
        keep = keep[exact[keep] >= self.cut[query[keep]]]
        return query[keep], which[keep], exact[keep]

    def _cut_for(self, left: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Closeness a row needs for each query to be among the best k."""
        cut = self.cut[part]
        if np.isneginf(cut).any():
            # The k-th best of some rows is a lower bound for the k-th best of all.
            cut = np.maximum(cut, self.scorer.at_least(left[: max(_CUT_ROWS, 4 * self.k)], part, self.k))
        return cut

    def _raise_cut(self, query: np.ndarray, close: np.ndarray) -> None:
        """Queries with k rows among the given ones need at least the worst of these."""
        counts = np.bincount(query, minlength=len(self.cut))
        worst = np.full(len(self.cut), np.inf)
        np.minimum.at(worst, query, close)
        full = counts >= self.k
        self.cut[full] = np.maximum(self.cut[full], worst[full])

    def _merge(self, table: pa.Table, query: np.ndarray, row: np.ndarray, close: np.ndarray) -> None:
        names = [n for n in table.column_names if n not in (self.vec_col, self.cell_col)]
        fresh = table.select(names).take(pa.array(row))
        fresh = fresh.append_column("_q", pa.array(query, pa.int64())).append_column("_close", pa.array(close))
        both = fresh if self.best is None else pa.concat_tables([self.best, fresh])
        q, c = both.column("_q").to_numpy(), both.column("_close").to_numpy()
        keep = _first_k(q, c, _positions(both, self.order), self.k)
        self.best = both.take(pa.array(keep)).combine_chunks()
        self._raise_cut(q[keep], c[keep])

    def result(self) -> pa.Table | None:
        if self.best is None:
            return None
        ids = self.block.ids.take(self.best.column("_q").combine_chunks())
        return self.best.append_column("_query", ids).drop_columns(["_q"])


def row_blocks(batches: Iterator[pa.RecordBatch], vec_col: str, dims: int) -> Iterator[pa.Table]:
    """Arrow batches joined up to a bounded number of vectors."""
    held, rows = [], 0
    limit = max(1, ROW_BLOCK_BYTES // (8 * dims))
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= limit:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)
