"""Hard negatives by segment summaries.

Each vector is stored with the mean and the deviation of its segments of four components. The inner product of two
segments lies within ``length * (mean * mean +- deviation * deviation)``, so the sums over the segments bound a score
from both sides without the vectors. Segments are refined from coarse (sixteen components, worked out of the stored
ones) to fine; a pair whose bounds leave what is looked for is dropped at each level, and what remains is scored exactly.

There are two searches of this kind: the positives of an anchor, which are its best rows of the same label, and then
for each positive the best rows of other labels within a window of scores below the positive's. Anchors meet the rows in
cells of bounded size; the best rows of each cell are merged.

Defined cases: rows with a null label, or a vector that is null or holds a null or non-finite component, take no part;
nor do, for an anchor, rows whose vector has another length. Empty vectors score 0 with each other. Rows without id can be
found, ranked after the others of their score; they are no anchors. Rows that share an id are rows of their own, but none
is found for an anchor of that id. An anchor id that repeats counts once, with the smallest of its (vector, label). Scores
beyond a long are its ends. Further columns are not looked at; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipatlas.llm.vector_cells import as_longs, deal_rows, exact, in_shards, kth_best, matrix, meet, scaled, taking_part, within_long

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (50, 95)
#: Components of a stored segment, and stored segments in one of the coarse level.
SEGMENT, COARSE = 4, 4
#: Anchors whose bounds with all rows of a cell are looked at together, and rows that are scored first.
_ANCHORS, _FIRST = 256, 256
#: Relative to the lengths of two vectors, more than the rounding of their bounds.
_SLACK = 2.0**-40
_FACTS = "label string, v array<double>, segments array<double>"
_FOUND_POSITIVE = "query_id long, label string, positive_id long, positive_score long"
_FOUND_NEGATIVE = "query_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long"


def summaries(vectors: np.ndarray, length: int = SEGMENT) -> np.ndarray:
    """For each vector the means and then the deviations of its segments; the last one is filled up with zeros."""
    n, dims = vectors.shape
    count = -(-dims // length)
    parts = np.zeros((n, count * length))
    parts[:, :dims] = vectors
    parts = parts.reshape(n, count, length)
    with np.errstate(all="ignore"):  # numbers too large for a deviation give one that bounds nothing
        return np.concatenate([parts.mean(axis=2), parts.std(axis=2)], axis=1)


def coarser(fine: np.ndarray, together: int = COARSE) -> np.ndarray:
    """Summaries of segments made of ``together`` equal segments each."""
    half = fine.shape[1] // 2
    count = -(-half // together)
    means, deviations = (np.zeros((len(fine), count * together)) for _ in range(2))
    means[:, :half], deviations[:, :half] = fine[:, :half], fine[:, half:]
    means, deviations = (m.reshape(len(fine), count, together) for m in (means, deviations))
    mean = means.mean(axis=2)
    spread = (deviations**2 + (means - mean[:, :, None]) ** 2).mean(axis=2)
    return np.concatenate([mean, np.sqrt(spread)], axis=1)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("v")
        flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        lengths = np.diff(at)
        found: list = [None] * batch.num_rows
        for dims in np.unique(lengths):
            rows = np.flatnonzero(lengths == dims)
            for row, summary in zip(rows, summaries(flat[at[rows][:, None] + np.arange(dims)]), strict=True):
                found[row] = summary
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float64()))], [*batch.schema.names, "segments"])


def store_vectors(rows: DataFrame, folder: str, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v, segments of the rows that take part: the table that both searches read."""
    kept = rows.where(taking_part(F.col("embedding"), scale) & F.col("label").isNotNull())
    narrow = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), scaled(F.col("embedding"), scale).alias("v"))
    schema = f"vec_id long, {_FACTS}"
    narrow.mapInArrow(_summarised, schema).write.parquet(f"{folder}/vectors")
    return rows.sparkSession.read.schema(schema).parquet(f"{folder}/vectors")


class _Side:
    """Vectors of a cell with their summaries at both levels, coarse first."""

    def __init__(self, vectors: np.ndarray, segments: np.ndarray):
        self.vectors = vectors
        with np.errstate(all="ignore"):
            self.levels = [(coarser(segments), SEGMENT * COARSE), (segments, SEGMENT)]
            self.lengths = np.sqrt(SEGMENT * (segments**2).sum(axis=1))

    def part(self, rows: np.ndarray) -> _Side:
        some = object.__new__(_Side)
        some.vectors, some.lengths = self.vectors[rows], self.lengths[rows]
        some.levels = [(m[rows], length) for m, length in self.levels]
        return some


def _open_pairs(rows: _Side, anchors: _Side, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each row and anchor, whether the bounds at all levels leave a score from ``least`` to ``most`` possible."""
    alive = np.ones((len(rows.lengths), len(anchors.lengths)), bool)
    for level in range(2):
        (mine, length), (theirs, _) = rows.levels[level], anchors.levels[level]
        some = np.flatnonzero(alive.any(axis=1))
        if not len(some):
            break
        half = mine.shape[1] // 2
        with np.errstate(all="ignore"):
            middle = length * (mine[some, :half] @ theirs[:, :half].T)
            spread = length * (mine[some, half:] @ theirs[:, half:].T) + _SLACK * np.outer(rows.lengths[some], anchors.lengths) + 1e-6
            # Written so that bounds that overflow let the pair pass.
            alive[some] &= ~(middle + spread < least) & ~(middle - spread > most)
    return alive


class _Cell:
    """Rows and anchors of a cell, the rows by id, those without one last."""

    def __init__(self, rows: pa.Table, anchors: pa.Table):
        ids = rows.column("vec_id").to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        vectors, asked = exact(matrix(rows)[order], matrix(anchors))
        self.ids = [ids[i] for i in order]
        self.rows = _Side(vectors, matrix(rows, "segments")[order])
        self.anchors = _Side(asked, matrix(anchors, "segments"))
        self.anchor_ids = anchors.column("query_id").to_pylist()
        known = np.array([i is not None for i in self.ids], bool)
        numbers = np.array([i or 0 for i in self.ids], np.int64)
        own = np.array(self.anchor_ids, np.int64)
        self.known, self.numbers, self.own = known, numbers, own
        names = np.array(rows.column("label").to_pylist(), object)[order]
        self.labels, codes = np.unique(np.concatenate([names, np.array(anchors.column("label").to_pylist(), object)]), return_inverse=True)
        self.row_label, self.anchor_label = codes[: len(names)], codes[len(names) :]

    def not_own(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        return ~(self.known[rows][:, None] & (self.numbers[rows][:, None] == self.own[anchors][None, :]))

    def scored(self, rows: np.ndarray, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor the rows that may lie within its bounds, in the order of their ids, and their exact scores."""
        mine, theirs = self.rows.part(rows), self.anchors.part(anchors)
        alive = _open_pairs(mine, theirs, least, most) & self.not_own(rows, anchors)
        some = np.flatnonzero(alive.any(axis=1))
        scores = within_long(mine.vectors[some] @ theirs.vectors.T)
        for column, anchor in enumerate(anchors):
            near = alive[some, column]
            yield anchor, rows[some[near]], scores[near, column]


def _blocks(members: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(members), _ANCHORS):
        yield members[at : at + _ANCHORS]


def _positives(k: int):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            cell = _Cell(rows, anchors)
            for code in np.unique(cell.anchor_label):
                same = np.flatnonzero(cell.row_label == code)
                for some in _blocks(np.flatnonzero(cell.anchor_label == code)):
                    if not len(same):
                        continue
                    # What the first rows reach, all the best ones have to reach.
                    first, all_scores = same[:_FIRST], np.full(len(some), -np.inf)
                    seen = cell.rows.vectors[first] @ cell.anchors.vectors[some].T
                    free = cell.not_own(first, some)
                    for column in range(len(some)):
                        all_scores[column] = kth_best(seen[free[:, column], column], k)
                    for anchor, near, scores in cell.scored(same, some, all_scores, np.full(len(some), np.inf)):
                        best = np.argsort(-scores, kind="stable")[:k]
                        found[0].extend([cell.anchor_ids[anchor]] * len(best))
                        found[1].extend([cell.labels[code]] * len(best))
                        found[2].extend(cell.ids[near[i]] for i in best)
                        found[3].extend(scores[best].tolist())
        kinds = [pa.int64(), pa.string(), pa.int64()]
        arrays = [pa.array(x, t) for x, t in zip(found, kinds, strict=False)]
        return pa.Table.from_arrays([*arrays, as_longs(found[3])], ["query_id", "label", "positive_id", "positive_score"])

    return search


def _negatives(k: int, window: tuple[int, int]):
    def search(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in range(6)]
        if rows.num_rows and anchors.num_rows:
            cell = _Cell(rows, anchors)
            positives = anchors.column("positives").to_pylist()
            # 100 * score from window[0] * positive to window[1] * positive, in whole numbers.
            spans = [[(-(-window[0] * p["score"] // 100), window[1] * p["score"] // 100) for p in ps] for ps in positives]
            for code in np.unique(cell.anchor_label):
                other = np.flatnonzero(cell.row_label != code)
                for some in _blocks(np.flatnonzero(cell.anchor_label == code)):
                    if not len(other):
                        continue
                    least, most = np.full(len(some), np.inf), np.full(len(some), -np.inf)
                    seen = within_long(cell.rows.vectors[other[:_FIRST]] @ cell.anchors.vectors[some].T)
                    free = cell.not_own(other[:_FIRST], some)
                    for column, anchor in enumerate(some):
                        scores = seen[free[:, column], column]
                        for low, high in spans[anchor]:
                            if low <= high:
                                reached = kth_best(scores[(scores >= low) & (scores <= high)], k)
                                least[column] = min(least[column], max(low, reached))
                                most[column] = max(most[column], high)
                    for anchor, near, scores in cell.scored(other, some, least, most):
                        order = np.argsort(-scores, kind="stable")
                        ranked = scores[order]
                        for nth, ((low, high), p) in enumerate(zip(spans[anchor], positives[anchor], strict=True)):
                            begin = int(np.searchsorted(-ranked, -high)) if low <= high else len(ranked)
                            for i in range(begin, min(begin + k, len(ranked))):
                                if ranked[i] < low:
                                    break
                                values = (cell.anchor_ids[anchor], nth, p["id"], p["score"], cell.ids[near[order[i]]], ranked[i])
                                for column, value in zip(found, values, strict=True):
                                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [pa.array(x, t) for x, t in zip(found, kinds, strict=False)]
        names = ["query_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.Table.from_arrays([*arrays, as_longs(found[5])], names)

    return search


def mine_hard_negatives(
    spark: SparkSession,
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` is a table of ``store_vectors`` and ``anchors`` some of its rows. Scores are inner products of the stored
    vectors; of equal ones the smaller id comes first. ``rank`` counts from 1 for each anchor and positive.
    """
    content = F.min(F.struct("v", "label", "segments")).alias("least")
    asked = anchors.where(F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").alias("query_id")).agg(content).select("query_id", "least.*")
    dealt, cells, n_shards = deal_rows(vectors, asked)
    near = meet(dealt, in_shards(cells, n_shards), _positives(positives), _FOUND_POSITIVE)
    best = Window.partitionBy("query_id").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    ranked = near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= positives)
    # At most ``positives`` of an anchor.
    lists = ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives"))
    found = meet(dealt, in_shards(cells.join(lists, "query_id"), n_shards), _negatives(negatives, window), _FOUND_NEGATIVE)
    hardest = Window.partitionBy("query_id", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    rank = F.row_number().over(hardest).cast("int").alias("rank")
    shown = found.select(F.col("query_id").alias("anchor_id"), "positive_id", rank, "negative_id", "positive_score", "negative_score")
    return shown.where(F.col("rank") <= negatives)
