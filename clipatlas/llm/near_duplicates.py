"""Near duplicates by b-bit MinHash.

1. Every text becomes its set of word shingles, 128 minima and a digest of the set. Equal sets become one
   node, the smallest doc_id of the copies, so thousands of copies are one node.
2. Bands of four minima are bucket keys. Of each minimum four bits are kept; 64 packed bytes are a signature,
   and the likeness of two nodes is estimated from their equal nibbles, corrected for chance collisions.
3. Candidates of a bucket are first the pairs of its members with its smallest node (a star, one row for each
   member). Candidates that the estimate does not rule out are confirmed on their full shingle sets.
4. Components of confirmed links are contracted. Only pairs of one bucket that still lie in different
   components, and were not in a star, are looked at further, in blocks of a task: first by the estimate, which
   names the nodes with such a partner, then on the full sets of these nodes. A task sends links that join two
   components, never pairs, so no link between components is lost and no group sends all its pairs.

Full sets are made only of nodes that are candidates. A bitmap of fixed size over hashes of their ids goes to
the tasks that read the texts, so the texts themselves are never shuffled.

With four minima in each of 32 bands, a pair at the threshold of 0.75 misses all buckets with a probability
of 5e-6. The estimate has a standard deviation of 0.04 there; candidates below 0.56 are ruled out (4.7
deviations). Both err less above the threshold.

Defined cases: a text without words, or null, has no shingles and no links. Rows that share a doc_id are one
document. Rows without doc_id take part, but give no name to a group: their component is that of the group,
or null. Empty tables give empty tables; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm.components import connected_components
from clipatlas.llm.shingles import ShingleReader, mix

BANDS, ROWS, BITS = 32, 4, 4
HASHES = BANDS * ROWS
THRESHOLD = 75
_WORDS = HASHES * BITS // 64
#: Estimated likeness under which a candidate is ruled out.
_FLOOR = 0.56
#: Members of a bucket that are compared in a task at a time.
_BLOCK = 2048
_PIECE = 4096
_LOW_BITS = 0x1111111111111111
#: Bits of the map of candidates. With many more candidates it lets every text through, and only costs time.
_MAP_BITS = 1 << 22

_SIGNATURES = "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>, signature array<long>"


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    reader = ShingleReader()
    factors = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
    salts = mix(np.arange(1000, 1000 + BANDS, dtype=np.uint64))
    shifts = np.arange(16, dtype=np.uint64) * np.uint64(BITS)
    for batch in batches:
        n = batch.num_rows
        sizes, digests, minima = np.zeros(n, np.int64), np.zeros((n, 2), np.int64), np.full((n, HASHES), np.iinfo(np.uint64).max, np.uint64)
        for i, shingles in enumerate(reader.sets(t.as_py() for t in batch.column("text"))):
            sizes[i] = len(shingles)
            digests[i] = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
            for begin in range(0, len(shingles), _PIECE):
                products = shingles[begin : begin + _PIECE, None] * factors
                np.minimum(minima[i], products.min(axis=0), out=minima[i])
        grouped = minima.reshape(n, BANDS, ROWS)
        keys = np.broadcast_to(salts, (n, BANDS)).copy()
        for r in range(ROWS):
            keys = mix(keys ^ grouped[:, :, r])
        nibbles = (mix(minima) & np.uint64(15)).reshape(n, _WORDS, 16)
        packed = np.bitwise_or.reduce(nibbles << shifts, axis=2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), _lists(keys), _lists(packed)],
            ["doc_id", "n_shingles", "d0", "d1", "bands", "signature"],
        )


def _shingle_sets(spark: SparkSession, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, shingles of the documents whose doc_id is among ``nodes``, and of a few others."""
    slot = F.pmod(F.xxhash64(F.col("node")), F.lit(_MAP_BITS))
    words = (
        nodes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits")).collect()  # at most _MAP_BITS / 64 rows
    )
    bitmap = np.zeros(_MAP_BITS // 64, np.uint64)
    for row in words:
        bitmap[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    sent = spark.sparkContext.broadcast(bitmap)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShingleReader()
        for batch in batches:
            slots = np.asarray(batch.column("slot")).astype(np.uint64)
            marked = (sent.value[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(marked.astype(bool)))
            sets = list(reader.sets(t.as_py() for t in batch.column("text")))
            arrays = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), arrays], ["node", "shingles"])

    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("node"), "text")
    return named.withColumn("slot", slot).mapInArrow(task, "node long, shingles array<long>")


def equal_nibbles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the kept minima agree, for signatures in rows."""
    x = a ^ b
    x = x | (x >> np.uint64(1))
    x = x | (x >> np.uint64(2))
    return HASHES - np.bitwise_count(x & np.uint64(_LOW_BITS)).sum(axis=-1, dtype=np.int64)


def likeness(equal):
    """The similarity estimated from the number of equal nibbles: chance makes 1 of 16 agree."""
    chance = 1 / (1 << BITS)
    return (equal / HASHES - chance) / (1 - chance)


#: The least number of equal nibbles that the floor asks for.
_LEAST_EQUAL = next(n for n in range(HASHES + 1) if likeness(n) >= _FLOOR)


def _equal_nibbles(a: str, b: str) -> Column:
    """The same count as ``equal_nibbles``, as an expression over two array columns."""

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        pairs = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(pairs.bitwiseOR(F.shiftrightunsigned(pairs, 2)).bitwiseAND(F.lit(_LOW_BITS)))

    total = differing(0)
    for i in range(1, _WORDS):
        total = total + differing(i)
    return F.lit(HASHES) - total


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks, which come sorted by bucket and blocks."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = np.stack([np.asarray(batch.column(c)) for c in ("key", "left", "right")], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin == end:
                continue
            if held and (keys[begin] != current).any():
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = keys[begin]
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Cell:
    """The members of one or two blocks of a bucket; ``near`` gives the partners of one by the estimate."""

    def __init__(self, table: pa.Table) -> None:
        names = ("node", "component", "chunk", "left", "right", "pivot")
        self.node, self.component, self.chunk, left, right, pivot = (np.asarray(table.column(c)) for c in names)
        flat = table.column("signature").combine_chunks().flatten()
        self.signature = np.asarray(flat).view(np.uint64).reshape(-1, _WORDS)
        self.left, self.right, self.cross = left[0], right[0], left[0] != right[0]
        self.open = self.node != pivot

    def near(self, i: int, component: np.ndarray) -> np.ndarray:
        """Members after ``i`` (of the other block, if there are two) that are likely partners in other components."""
        if not self.open[i] or self.cross and self.chunk[i] != self.left:
            return np.empty(0, np.int64)
        start = 0 if self.cross else i + 1
        other = self.open[start:] & (component[start:] != component[i])
        if self.cross:
            other &= self.chunk[start:] == self.right
        found = np.flatnonzero(other) + start
        return found[equal_nibbles(self.signature[i], self.signature[found]) >= _LEAST_EQUAL] if len(found) else found


def _with_partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that have a likely partner in another component of their bucket."""
    for table in _by_cell(batches):
        cell = _Cell(table)
        marked = np.zeros(len(cell.node), bool)
        for i in range(len(cell.node)):
            found = cell.near(i, cell.component)
            marked[found] = True
            marked[i] |= len(found) > 0
        if marked.any():
            yield pa.RecordBatch.from_arrays([pa.array(cell.node[marked])], ["node"])


def _links_between(threshold: int):
    """Links, confirmed on full sets, that join components of a bucket; no two join the same components in a cell."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_cell(batches):
            cell = _Cell(table)
            component = cell.component.copy()
            column = table.column("shingles").combine_chunks()
            offsets, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)  # sorted as unsigned
            sizes = np.diff(offsets)
            links = []
            for i in range(len(cell.node)):
                found = cell.near(i, component)
                own = flat[offsets[i] : offsets[i + 1]]
                for begin in range(0, len(found), 256):
                    part = found[begin : begin + 256]
                    rows = np.concatenate([flat[offsets[j] : offsets[j + 1]] for j in part.tolist()])
                    place = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                    starts = np.cumsum(sizes[part]) - sizes[part]
                    shared = np.add.reduceat(own[place] == rows, starts, dtype=np.int64)
                    alike = 100 * shared >= threshold * (sizes[i] + sizes[part] - shared)
                    for j in part[alike].tolist():
                        if component[j] != component[i]:
                            links.append((min(cell.node[i], cell.node[j]), max(cell.node[i], cell.node[j])))
                            component[component == component[j]] = component[i]
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return task


def _confirmed(candidates: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of the candidate pairs a, b those whose full shingle sets are alike enough."""
    both = (
        candidates.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        .select("a", "b", F.size("of_a").alias("n_a"), F.size("of_b").alias("n_b"), F.size(F.array_intersect("of_a", "of_b")).alias("shared"))
    )
    return both.where(100 * F.col("shared") >= threshold * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b").distinct()


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, folder: str, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; tables of the run go below ``folder``.

    Two documents are linked if 100 x the size of the intersection of their shingle sets is at least
    ``threshold`` x the size of the union; ``component_id`` is the smallest doc_id reachable by links.
    """

    def kept_at(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = kept_at("signatures", docs.mapInArrow(_sign, _SIGNATURES))
    worded = signed.where(F.col("n_shingles") > 0)
    sets = kept_at("sets", worded.groupBy("d0", "d1").agg(F.min("doc_id").alias("node")))
    named = sets.where(F.col("node").isNotNull())
    nodes = kept_at(
        "nodes",
        worded.join(named.select("d0", "d1", F.col("node").alias("doc_id")), ["doc_id", "d0", "d1"], "left_semi")
        .groupBy(F.col("doc_id").alias("node"), "d0", "d1").agg(F.first("bands").alias("bands"), F.first("signature").alias("signature")),
    )
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = kept_at(
        "buckets", members.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("members")).where(F.col("members") > 1)
    )
    signatures = nodes.select("node", "signature")
    star = (
        members.join(buckets, "key").where(F.col("node") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        .join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("of_b")), "b")
        .join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("of_a")), "a")
        .where(_equal_nibbles("of_a", "of_b") >= _LEAST_EQUAL)
        .select("a", "b").distinct()
    )
    star = kept_at("star", star)
    in_star = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    star_sets = kept_at("star-sets", _shingle_sets(spark, docs, in_star))
    links = kept_at("star-links", _confirmed(star, star_sets, threshold))
    components = connected_components(spark, links, f"{folder}/star-components")

    # Buckets that the star links did not contract to one component.
    placed = (
        members.join(buckets.where(F.col("members") > 2), "key")
        .join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    open_keys = (
        placed.where(F.col("node") != F.col("pivot")).groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where(F.col("low") != F.col("high")).select("key")
    )
    blocks = F.ceil(F.col("members") / _BLOCK).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    in_cells = (
        placed.join(open_keys, "key", "left_semi").withColumn("blocks", blocks)
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .select("key", "node", "component", "pivot", "chunk", other)
        .select("key", "node", "component", "pivot", "chunk", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"))
    )
    in_cells = kept_at("cells", in_cells)

    def by_cell(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "node")

    partners = by_cell(in_cells.join(signatures, "node")).mapInArrow(_with_partners, "node long").distinct()
    partners = kept_at("partners", partners)
    rest_sets = kept_at("rest-sets", _shingle_sets(spark, docs, partners))
    rest = in_cells.join(partners, "node", "left_semi").join(signatures, "node").join(rest_sets, "node")
    more = kept_at("rest-links", by_cell(rest).mapInArrow(_links_between(threshold), "a long, b long").distinct())
    if not more.isEmpty():
        components = connected_components(spark, links.unionByName(more), f"{folder}/components")

    grouped = sets.join(components, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component"))
    found = worded.select("doc_id", "n_shingles", "d0", "d1").join(grouped, ["d0", "d1"], "left").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = signed.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
