"""Quality of documents: random-indexing word vectors, pooled, and a small network on top.

Random indexing: every word has a fixed sparse vector of a few +1 and -1; the vector of a word is the sum
of the sparse vectors of its neighbours over the whole corpus. Words are hashed into a fixed number of
slots, so the table of vectors has a size that does not grow with the corpus (``SLOTS`` x ``WIDTH`` numbers)
and may be broadcast, while every word of every document counts. Sums are integers: their order, lost
executors and repeated tasks do not change them.

The network (two layers, numpy) is fitted on the driver on at most ``SAMPLE`` labelled rows, the first by
hash of doc_id; a fifth of them is kept to choose the temperature that calibrates its probabilities.

Defined cases: a null text is an empty text; an empty text has zero features and the score the network gives
to them; several labels of one document count with the largest; labels of unknown documents are ignored;
without both labels in the sample every score is the share of label 1 (0.5 without labels). Repeated rows
get equal scores, further columns are not looked at, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SLOTS, WIDTH, CHUNK = 1 << 15, 32, 512
FEATURES = 2 * WIDTH + 3
#: Non-zero places of a sparse vector, and neighbours looked at on each side.
NONZERO, REACH = 4, 2
#: The bound on labelled rows that the network is fitted on.
SAMPLE = 20_000
#: A document with this score or more is accepted.
ACCEPTED = 0.3
HIDDEN, EPOCHS, RATE, BATCH = 32, 60, 3e-3, 256
#: Steps of the fit at least, for few rows, and how strongly the weights of an input are shrunk.
LEAST_STEPS, SHRINK = 3000, 0.2
#: Sums of one chunk are added in so many groups first.
_GROUPS = 32
#: Words whose slot a task remembers.
_REMEMBERED = 1 << 17
#: Words of a text that are looked at together; a very long text is taken in pieces, its sums are the same.
_PIECE = 1 << 16


class _Slots(dict):
    """word -> slot. Upper and lower case differ, since shouting is a sign of quality."""

    def __missing__(self, word: str) -> int:
        from zlib import crc32

        if len(self) >= _REMEMBERED:
            self.clear()
        slot = self[word] = crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        return slot


def _sparse_vectors() -> np.ndarray:
    draw = np.random.default_rng(7)
    vectors = np.zeros((SLOTS + 1, WIDTH), np.int16)
    places = draw.random((SLOTS, WIDTH)).argsort(axis=1)[:, :NONZERO]
    vectors[np.arange(SLOTS)[:, None], places] = draw.choice([-1, 1], (SLOTS, NONZERO))
    return vectors  # the last row is zero: beyond the ends of a text


def _reader():
    import re

    words = re.compile(r"[^\W\d_]+|[\d_]+|[^\w\s]+")
    slots = _Slots()

    def read(text: str | None) -> np.ndarray:
        found = words.findall(text or "")
        return np.fromiter(map(slots.__getitem__, found), np.int32, len(found))

    return read


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one task: for each chunk of slots their vectors and counts."""
    read, sparse = _reader(), _sparse_vectors()
    sums, counts = np.zeros((SLOTS, WIDTH), np.int64), np.zeros(SLOTS, np.int64)
    gap = np.full(REACH, SLOTS, np.int32)
    held: list[np.ndarray] = []
    size = 0

    def add() -> None:
        nonlocal size
        if not held:
            return
        ids = np.concatenate([gap, *held])
        for begin in range(0, len(ids), _PIECE):
            low, high = max(0, begin - REACH), min(len(ids), begin + _PIECE + REACH)
            around = sparse[ids[low:high]]
            padded = np.concatenate([np.zeros((REACH, WIDTH), np.int16), around, np.zeros((REACH, WIDTH), np.int16)])
            near = sum(padded[REACH + d : REACH + d + len(around)] for d in range(-REACH, REACH + 1) if d)
            own = slice(begin - low, begin - low + min(_PIECE, len(ids) - begin))
            mine, near = ids[begin : begin + _PIECE], near[own]
            order = np.argsort(mine, kind="stable")
            slots, starts = np.unique(mine[order], return_index=True)
            total = np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)
            real = slots < SLOTS
            sums[slots[real]] += total[real]
            counts[:] += np.bincount(mine[mine < SLOTS], minlength=SLOTS)
        held.clear()
        size = 0

    for batch in batches:
        for text in batch.column("text"):
            held.extend((read(text.as_py()), gap))
            size += len(held[-2])
            if size >= _PIECE:
                add()
    add()
    used = np.flatnonzero(counts.reshape(-1, CHUNK).any(axis=1))
    group = TaskContext.get().partitionId() % _GROUPS
    for chunk in used.tolist():
        rows = slice(chunk * CHUNK, (chunk + 1) * CHUNK)
        yield _row(chunk, group, np.concatenate([sums[rows], counts[rows, None]], axis=1))


def _row(chunk: int, group: int, table: np.ndarray) -> pa.RecordBatch:
    small = table.astype(np.int32) if np.abs(table).max(initial=0) < 1 << 31 else table
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int32()), pa.array([group], pa.int32()), pa.array([small.dtype.itemsize], pa.int32()), pa.array([small.tobytes()], pa.binary())],
        ["chunk", "part", "size", "sums"],
    )


def _added(keep_group: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for chunk, group, size, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "part", "size", "sums")), strict=True):
                table = np.frombuffer(data, np.int32 if size == 4 else np.int64).reshape(CHUNK, WIDTH + 1).astype(np.int64)
                key = (chunk, group if keep_group else 0)
                totals[key] = totals[key] + table if key in totals else table
        for (chunk, group), table in totals.items():
            yield _row(chunk, group, table)

    return task


_SUMS = "chunk int, part int, size int, sums binary"


@dataclass(frozen=True)
class WordVectors:
    """Unit vectors and weights of the slots; rare words weigh more."""

    vectors: np.ndarray
    weights: np.ndarray


def learn_vectors(docs: DataFrame) -> WordVectors:
    """Word vectors from every text of ``docs``. What comes back to the driver has the fixed size of the table."""
    sums = docs.select("text").mapInArrow(_context_sums, _SUMS)
    grouped = sums.repartition("chunk", "part").mapInArrow(_added(True), _SUMS)
    total = grouped.repartition("chunk").mapInArrow(_added(False), _SUMS)
    table = np.zeros((SLOTS, WIDTH + 1), np.float64)
    for row in total.toLocalIterator():
        table[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["sums"], np.int32 if row["size"] == 4 else np.int64).reshape(CHUNK, -1)
    vectors, counts = table[:, :WIDTH], table[:, WIDTH]
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    return WordVectors((vectors / np.where(length > 0, length, 1)).astype(np.float32), (1e-3 / (1e-3 + share)).astype(np.float32))


def _pooled(ids: np.ndarray, words: WordVectors) -> np.ndarray:
    """Weighted mean and spread of the word vectors of a text, likeness of neighbours, share of different words."""
    if not len(ids):
        return np.zeros(FEATURES, np.float32)
    first, second, weight = np.zeros(WIDTH), np.zeros(WIDTH), 0.0
    for begin in range(0, len(ids), _PIECE):
        part = ids[begin : begin + _PIECE]
        w, v = words.weights[part], words.vectors[part]
        first += w @ v
        second += w @ (v * v)
        weight += float(w.sum(dtype=np.float64))
    mean = first / weight
    near = [_likeness(ids, lag, words) for lag in (1, 2)]
    different = len(np.unique(ids)) / len(ids)
    return np.concatenate([mean, np.sqrt(np.maximum(second / weight - mean * mean, 0)), near, [different]]).astype(np.float32)


def _likeness(ids: np.ndarray, lag: int, words: WordVectors) -> float:
    """Mean cosine of the vectors of words ``lag`` places apart."""
    total = 0.0
    for begin in range(0, len(ids) - lag, _PIECE):
        left = ids[begin : min(begin + _PIECE, len(ids) - lag)]
        right = ids[begin + lag : begin + lag + len(left)]
        total += float(np.einsum("ij,ij->", words.vectors[left], words.vectors[right], dtype=np.float64))
    return total / max(1, len(ids) - lag)


@dataclass(frozen=True)
class Network:
    center: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        inner = np.maximum((features - self.center) / self.scale @ self.hidden + self.hidden_bias, 0)
        return inner @ self.out + self.out_bias

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(features) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
    z = np.clip(logits, -40, 40)
    return float(np.mean(np.log1p(np.exp(z)) - truth * z))


def fit_network(features: np.ndarray, labels: np.ndarray, kept: np.ndarray) -> Network:
    """Two layers by Adam on the rows not ``kept``, with the weights of an input shrunk together, so that inputs that say
    nothing go to zero. Of all passes the one with the greatest likelihood of the kept rows stays; so does the temperature."""
    width = features.shape[1]
    share = float(labels.mean()) if len(labels) else 0.5
    constant = Network(np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    fit = ~kept if len(np.unique(labels[~kept])) == 2 else np.ones(len(labels), bool)
    if len(np.unique(labels[fit])) < 2:
        return constant
    x, y = features[fit].astype(np.float64), labels[fit].astype(np.float64)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - center) / scale
    draw = np.random.default_rng(11)
    p = [draw.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    aside, truth = (features[kept] - center) / scale, labels[kept]
    best, least = None, np.inf
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
        order = draw.permutation(len(x))
        for begin in range(0, len(x), BATCH):
            rows = order[begin : begin + BATCH]
            xb, yb = x[rows], y[rows]
            inner = xb @ p[0] + p[1]
            active = np.maximum(inner, 0)
            error = (_sigmoid(active @ p[2] + p[3][0]) - yb) / len(rows)
            back = np.outer(error, p[2]) * (inner > 0)
            slopes = [xb.T @ back + 1e-4 * p[0], back.sum(axis=0), active.T @ error + 1e-4 * p[2], np.array([error.sum()])]
            t += 1
            for a, g, s, q in zip(p, slopes, m, v, strict=True):
                s *= 0.9
                s += 0.1 * g
                q *= 0.999
                q += 0.001 * g * g
                a -= RATE * (s / (1 - 0.9**t)) / (np.sqrt(q / (1 - 0.999**t)) + 1e-8)
            length = np.linalg.norm(p[0], axis=1, keepdims=True)
            p[0] *= np.maximum(0, 1 - RATE * SHRINK * HIDDEN**0.5 / np.maximum(length, 1e-12))
        loss = _loss(np.maximum(aside @ p[0] + p[1], 0) @ p[2] + p[3][0], truth) if len(truth) else -t
        if loss < least:
            best, least = [a.copy() for a in p], loss
    p = best
    network = Network(center, scale, p[0], p[1], p[2], float(p[3][0]))
    if not kept.any():
        return network
    logits = network.logits(features[kept])
    warmth = min(np.geomspace(0.25, 8, 61), key=lambda temperature: _loss(logits / temperature, truth))
    return Network(center, scale, p[0], p[1], p[2], float(p[3][0]), float(warmth))


def _features_of(spark: SparkSession, docs: DataFrame, words: WordVectors, extra: str) -> DataFrame:
    sent = spark.sparkContext.broadcast((words.vectors, words.weights))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, learned = _reader(), WordVectors(*sent.value)
        for batch in batches:
            rows = [_pooled(read(t.as_py()), learned).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column(extra), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", extra, "features"])

    return docs.select("doc_id", extra, "text").mapInArrow(task, f"doc_id long, {extra} int, features array<float>")


def learn_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, words: WordVectors, sample: int = SAMPLE) -> Network:
    """The network from ``labels`` (doc_id, quality) and the texts of ``docs``; at most ``sample`` documents."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows of 12 bytes, a parameter
    rows = _features_of(spark, texts, words, "quality").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).collect()
    features = np.array([r["features"] for r in rows], np.float32).reshape(len(rows), FEATURES)
    truth = np.array([r["quality"] for r in rows], np.float64)
    kept = np.array([i % 5 == 0 for i in range(len(rows))], bool)
    return fit_network(features, truth, kept)


def score_quality(spark: SparkSession, docs: DataFrame, words: WordVectors, network: Network, into: str = "quality_score") -> DataFrame:
    """The columns of ``docs`` and ``into``, which replaces a column of that name. No shuffle; texts stay in place.

    Scores are rounded, since a product of matrices differs in its last bits with the number of rows in a batch.
    """
    sent = spark.sparkContext.broadcast((words.vectors, words.weights, vars(network)))
    docs = docs.drop(into)
    schema = StructType([*docs.schema.fields, StructField(into, DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader()
        vectors, weights, layers = sent.value
        learned, net = WordVectors(vectors, weights), Network(**layers)
        for batch in batches:
            pooled = np.array([_pooled(read(t.as_py()), learned) for t in batch.column("text")], np.float32).reshape(batch.num_rows, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(net.scores(pooled), 9), pa.float64())], [*batch.schema.names, into])

    return docs.mapInArrow(task, schema)
