"""Centroids in two levels: a few coarse ones, and under each of them those that the rows are stored by.

Both levels are fitted on a sample, of so many vectors for each centroid, copies of one vector counted once. The coarse
level is one task's work on a bounded part of the sample; each coarse centroid then has a task of its own, which fits
its fine ones on the sampled vectors nearest to it. The fine centroids are a table: they never pass the driver, and a
row is compared with the coarse ones and then with those below the nearest, not with all. So for n rows and sqrt(n)
cells assigning costs about n ** 1.25 products instead of n ** 1.5, and what is sent to every task is the coarse level
alone.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipatlas.operators.blocks import to_matrix

# Tasks get the code with the job, so that workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Sampled vectors for each centroid, and the most bytes of them that the coarse level is fitted on.
PER_CENTROID, COARSE_BYTES = 64, 32 << 20
#: The most bytes of coarse centroids; they are sent to all tasks.
SENT_BYTES = 8 << 20
#: Fine centroids below a coarse one at most, since one task fits them.
FINE_MOST = 1024
_PASSES = 10
_SCORE_BLOCK = 1 << 22

CENTROIDS = T.StructType(
    [T.StructField("cell", T.IntegerType()), T.StructField("coarse", T.IntegerType()), T.StructField("centre", T.ArrayType(T.DoubleType()))]
)
_VECTOR = "vector array<double>"
_COARSE = "coarse int, centre array<double>"


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zeros for rows without a direction."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.nan_to_num(np.divide(m, norms, out=np.zeros_like(m), where=norms > 0), nan=0.0, posinf=0.0, neginf=0.0)


def nearest_of(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector the place of the nearest centre and the cosine to it; of equal ones the first."""
    which, cosine = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    step = max(1, _SCORE_BLOCK // max(1, len(centres)))
    for at in range(0, len(rows), step):
        products = rows[at : at + step] @ centres.T
        which[at : at + step] = best = products.argmax(axis=1)
        cosine[at : at + step] = products[np.arange(len(best)), best]
    return which, cosine


def fit_centres(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Unit centres of at most ``k`` groups of unit vectors, by cosine: spread first choices, then a few passes."""
    rows = np.unique(rows, axis=0)
    k = min(k, len(rows))
    draw = np.random.default_rng(seed)
    centres = np.empty((k, rows.shape[1]))
    far = np.full(len(rows), np.inf)
    for i in range(k):
        share = far / far.sum() if i and far.sum() > 0 else None
        centres[i] = rows[draw.choice(len(rows), p=share)]
        far = np.minimum(far, np.maximum(0.0, 1 - rows @ centres[i]))
    for _ in range(_PASSES):
        which, _ = nearest_of(rows, centres)
        order = np.argsort(which, kind="stable")
        found, starts = np.unique(which[order], return_index=True)
        moved = centres.copy()
        moved[found] = unit(np.add.reduceat(rows[order], starts, axis=0))
        # A group whose sum has no direction keeps its centre, as does one that lost all its vectors.
        moved[~moved.any(axis=1)] = centres[~moved.any(axis=1)]
        if np.allclose(moved, centres, atol=1e-12):
            break
        centres = moved
    return centres


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow column; a row of another length or with NULL numbers is a zero vector."""
    right = column.value_lengths().fill_null(0).to_numpy() == dims
    vectors, whole = to_matrix(column.filter(pa.array(right)), dims)
    found = np.zeros((len(column), dims))
    found[np.flatnonzero(right)[whole]] = vectors[whole]
    return found


class CoarseCentroids:
    """The coarse level."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres

    def place(self, vector: Column) -> Column:
        """The nearest coarse centroid; -1 for a vector without a direction."""
        centres = self.centres

        @F.arrow_udf("int")
        def coarse(vectors: pa.Array) -> pa.Array:
            rows = unit(rows_of(vectors, centres.shape[1]))
            which, _ = nearest_of(rows, centres)
            return pa.array(np.where(rows.any(axis=1), which, -1), pa.int32())

        return coarse(vector)


def load_coarse(spark: SparkSession, folder: str) -> CoarseCentroids:
    level = sorted(spark.read.schema(_COARSE).parquet(f"{folder}/coarse").collect())  # at most SENT_BYTES
    return CoarseCentroids(np.array([r.centre for r in level]))


def load_fine(spark: SparkSession, folder: str, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For few centroids: cells, the coarse centroid of each, and the centroids, by coarse centroid and cell."""
    table = spark.read.schema(CENTROIDS).parquet(folder).toArrow().sort_by([("coarse", "ascending"), ("cell", "ascending")])
    return table.column("cell").to_numpy(), table.column("coarse").to_numpy(), rows_of(table.column("centre").combine_chunks(), dims)


def two_levels(coarse: CoarseCentroids, fine: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[Column], Column]:
    """For few centroids: a function that gives ``coarse``, ``cell`` and ``toward`` of a vector, from both levels at once.

    Both numbers are -1 for a missing vector and for one without a direction.
    """
    cells, above, centres = fine
    upper = coarse.centres
    begins = np.searchsorted(above, np.arange(len(upper) + 1))

    @F.arrow_udf("coarse int, cell int, toward double")
    def place(vectors: pa.Array) -> pa.Array:
        rows = unit(rows_of(vectors, centres.shape[1]))
        which, _ = nearest_of(rows, upper)
        cell, toward = np.full(len(rows), -1), np.zeros(len(rows))
        which[~rows.any(axis=1)] = -1
        for c in np.unique(which[which >= 0]):
            members = np.flatnonzero(which == c)
            best, cosine = nearest_of(rows[members], centres[begins[c] : begins[c + 1]])
            cell[members], toward[members] = cells[begins[c] + best], cosine
        return pa.StructArray.from_arrays([pa.array(which, pa.int32()), pa.array(cell, pa.int32()), pa.array(toward)], ["coarse", "cell", "toward"])

    return place


def place_below(vectors: pa.Array, below: pa.Table, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and cosine to its centroid for vectors that share a coarse centroid, from the fine ones ``below`` it."""
    rows = unit(rows_of(vectors, dims))
    if not below.num_rows:
        return np.full(len(rows), -1), np.zeros(len(rows))
    below = below.sort_by("cell")
    best, cosine = nearest_of(rows, rows_of(below.column("centre").combine_chunks(), dims))
    directed = rows.any(axis=1)
    return np.where(directed, below.column("cell").to_numpy()[best], -1), np.where(directed, cosine, 0.0)


def _below(size: int, n: int, nlist: int) -> int:
    """Fine centroids below a coarse one that ``size`` of ``n`` sampled vectors are nearest to."""
    return min(FINE_MOST, size, max(1, round(nlist * size / n)))


def _fit_at_once(sample: DataFrame, dims: int, nlist: int, n_coarse: int, folder: str, seed: int) -> int:
    """Both levels as one task's work, for a sample of at most COARSE_BYTES."""
    spark = sample.sparkSession

    def both(frame: pd.DataFrame) -> pd.DataFrame:
        rows = unit(np.array(frame["vector"].tolist(), np.float64).reshape(len(frame), dims))
        upper = fit_centres(rows, n_coarse, seed)
        which, _ = nearest_of(rows, upper)
        parts, cell = [], 0
        for number, c in enumerate(np.unique(which)):
            members = rows[which == c]
            centres = fit_centres(members, _below(len(members), len(rows), nlist), seed)
            parts.append(pd.DataFrame({"cell": np.arange(cell, cell + len(centres)), "coarse": number, "centre": centres.tolist(), "first": [upper[c].tolist()] + [None] * (len(centres) - 1)}))
            cell += len(centres)
        return pd.concat(parts)

    fitted = sample.groupBy().applyInPandas(both, "cell int, coarse int, centre array<double>, first array<double>").collect()
    spark.createDataFrame([r[:3] for r in fitted], CENTROIDS).coalesce(1).write.parquet(f"{folder}/centroids")
    level = [(r.coarse, r.first) for r in fitted if r.first is not None]
    spark.createDataFrame(level, _COARSE).coalesce(1).write.parquet(f"{folder}/coarse")
    return len(fitted)


def fit(vectors: DataFrame, dims: int, nlist: int, folder: str, seed: int) -> int:
    """Fit about ``nlist`` cells on ``vectors`` (vector) and write both levels as tables to ``folder``; how many cells there are.

    ``vectors`` are different vectors of length ``dims`` with a direction. Without two of them there is no cell.
    """
    spark = vectors.sparkSession
    vectors.write.parquet(f"{folder}/sample")
    sample = spark.read.schema(_VECTOR).parquet(f"{folder}/sample")
    n = sample.count()
    if n < 2:
        return 0
    n_coarse = int(max(1, min(round(nlist**0.5), SENT_BYTES // (8 * dims), n)))
    share = min(1.0, COARSE_BYTES / (8 * dims * n))
    if share == 1:
        return _fit_at_once(sample, dims, nlist, n_coarse, folder, seed)

    def coarse_level(rows: pd.DataFrame) -> pd.DataFrame:
        centres = fit_centres(unit(np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), dims)), n_coarse, seed)
        return pd.DataFrame({"centre": centres.tolist()})

    # By the hash of the vector, so that a task that is done again sees the same rows, COARSE_BYTES of them.
    hashed = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 20))
    some = sample.filter(hashed < max(1, round(share * (1 << 20))))
    fitted = some.groupBy().applyInPandas(coarse_level, "centre array<double>").collect()
    coarse = CoarseCentroids(np.array([r.centre for r in fitted]))
    sample.withColumn("coarse", coarse.place(F.col("vector"))).write.parquet(f"{folder}/placed")
    placed = spark.read.schema(f"{_VECTOR}, coarse int").parquet(f"{folder}/placed")
    sizes = {r.coarse: r["count"] for r in placed.groupBy("coarse").count().collect()}  # one row for each coarse centroid
    fine = np.array([_below(sizes.get(c, 0), n, nlist) for c in range(len(fitted))], np.int64)
    begins, many = np.append(0, np.cumsum(fine)).tolist(), fine.tolist()
    # Coarse centroids that no vector is nearest to go; the others are numbered anew.
    number = {c: i for i, c in enumerate(sorted(sizes))}

    def fine_level(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        centres = fit_centres(unit(np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), dims)), many[c], seed)
        return pd.DataFrame({"cell": np.arange(begins[c], begins[c] + len(centres)), "coarse": number[c], "centre": centres.tolist()})

    # PER_CENTROID vectors for each of the centroids that one task fits, on average.
    share_of = {c: max(1, round((1 << 20) * min(1.0, PER_CENTROID * many[c] / size))) for c, size in sizes.items()}
    limit = F.create_map(*[F.lit(x) for pair in share_of.items() for x in pair])[F.col("coarse")]
    placed.filter(hashed < limit).groupBy("coarse").applyInPandas(fine_level, CENTROIDS).write.parquet(f"{folder}/centroids")
    level = [(number[c], r.centre) for c, r in enumerate(fitted) if c in number]
    spark.createDataFrame(level, _COARSE).coalesce(1).write.parquet(f"{folder}/coarse")
    return begins[-1]
