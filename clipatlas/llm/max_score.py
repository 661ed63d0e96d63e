"""Exact top-k search by inner product with MaxScore.

Components are terms. A shard keeps the posting of each term, the weights of all its rows one after the other (components
of vectors are hardly ever zero), with the largest and the smallest weight. For a query, the larger of the products with
these two bounds what a term can add to a score. Terms are sorted by their bounds; the last ones, whose bounds together
stay below the k-th best score known, are not essential: a row cannot get among the best by them alone. The postings of
the essential terms are traversed; the rows that may still reach the k-th best score are probed in the other postings, a
few terms at a time, and leave as soon as the bounds of what is left do not suffice. The k best rows of each shard are
merged.

What the k-th best score is, is first found out on one shard, which bounds it from below for all others.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part; nor do those whose length
differs from the query's, for that query. Empty vectors score 0 with each other. Rows without id can be found, ranked after the
others of their score; a query without id is not asked. Rows that share an id are rows of their own, but none is a
candidate of a query of that id. A query id that repeats asks once, with the smallest of its vectors. Scores beyond a long are its ends.
Further columns are not looked at; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipatlas.llm.vector_cells import as_longs, deal_rows, exact, in_shards, kth_best, matrix, meet, scaled, taking_part, within_long

SCALE, RESULTS = 64, 20
#: Terms that candidates are probed in before the next look at the bounds.
_PROBED = 8
_FOUND = "query_id long, vec_id long, score long"


class Shard:
    """The postings of some rows, by term, with the bounds of their weights."""

    def __init__(self, ids: list, vectors: np.ndarray):
        # By id, rows without one last: ties then go to the earlier place.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        self.ids = [ids[i] for i in order]
        self.postings = np.ascontiguousarray(vectors[order].T)
        self.most = self.postings.max(axis=1) if len(ids) else self.postings.sum(axis=1)
        self.least = self.postings.min(axis=1) if len(ids) else self.postings.sum(axis=1)
        known = np.array([i is not None for i in self.ids], bool)
        self.known, self.numbers = known, np.array([i or 0 for i in self.ids], np.int64)

    def search(self, query: np.ndarray, own: int, k: int, floor: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the best k rows, best first; of those that reach ``floor`` if there is one."""
        bounds = np.maximum(query * self.most, query * self.least)
        terms = np.argsort(-bounds, kind="stable")
        rest = np.append(np.cumsum(bounds[terms][::-1])[::-1], 0)
        others = ~(self.known & (self.numbers == own))
        rows = np.flatnonzero(others)
        if floor is None and len(rows) > k:
            first = rows[: 4 * k]
            floor = kth_best(query @ self.postings[:, first], k)
        if floor is None:
            essential = len(terms)
        else:
            if rest[0] < floor:
                return rows[:0], query[:0]
            essential = int(np.argmax(rest < floor)) if (rest < floor).any() else len(terms)
        used = terms[:essential]
        score = query[used] @ self.postings[used] if essential else np.zeros(len(self.ids), query.dtype)
        if floor is not None:
            rows = rows[score[rows] + rest[essential] >= floor]
        score = score[rows]
        if floor is not None and essential < len(terms) and len(rows) > 2 * k:
            # The most promising rows are scored in full, which raises what the others have to reach.
            best = rows[np.argsort(-score, kind="stable")[: 2 * k]]
            floor = max(floor, kth_best(query @ self.postings[:, best], k))
        for at in range(essential, len(terms), _PROBED):
            part = terms[at : at + _PROBED]
            score = score + query[part] @ self.postings[np.ix_(part, rows)]
            if floor is not None:
                near = score + rest[min(at + _PROBED, len(terms))] >= floor
                rows, score = rows[near], score[near]
        score = within_long(score)
        if len(rows) > k:
            # All rows that reach the k-th score, in the order of their places, so that the sort keeps ties in order.
            near = score >= kth_best(score, k)
            rows, score = rows[near], score[near]
        order = np.argsort(-score, kind="stable")[:k]
        return rows[order], score[order]


def _cell(k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if rows.num_rows and queries.num_rows:
            vectors, asked = exact(matrix(rows), matrix(queries))
            shard = Shard(rows.column("vec_id").to_pylist(), vectors)
            floors = queries.column("floor").to_pylist()
            for own, floor, query in zip(queries.column("query_id").to_pylist(), floors, asked, strict=True):
                places, scores = shard.search(query, own, k, floor)
                found[0].extend([own] * len(places))
                found[1].extend(shard.ids[p] for p in places)
                found[2].extend(scores.tolist())
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": as_longs(found[2])})

    return search


def top_inner_products(spark: SparkSession, rows: DataFrame, queries: DataFrame, k: int = RESULTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``rows`` (vec_id, embedding) for each of ``queries``, likewise.

    The score is the inner product of the components times ``scale``, rounded down; ties go to the smaller id.
    """
    vector = scaled(F.col("embedding"), scale).alias("v")
    base = rows.where(taking_part(F.col("embedding"), scale)).select(F.col("vec_id").cast("long").alias("vec_id"), vector)
    asked = queries.where(taking_part(F.col("embedding"), scale) & F.col("vec_id").isNotNull())
    asked = asked.select(F.col("vec_id").cast("long").alias("query_id"), vector).groupBy("query_id").agg(F.min("v").alias("v"))
    dealt, cells, n_shards = deal_rows(base, asked)
    unknown = in_shards(cells, 1).withColumn("floor", F.lit(None).cast("long"))
    seen = meet(dealt.where("_shard = 0"), unknown, _cell(k), _FOUND)
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    rank = F.row_number().over(best_first).cast("int").alias("rank")
    floors = seen.select("query_id", F.col("score").alias("floor"), rank).where(F.col("rank") == k).drop("rank")
    known = in_shards(cells.join(floors, "query_id", "left"), n_shards)
    found = meet(dealt, known, _cell(k), _FOUND)
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)
