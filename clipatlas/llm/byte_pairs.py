"""Byte-level BPE of whole corpora: every distinct word is encoded once.

1. A block is what a task has read so far, up to a bound on its text. Its texts are cut into pre-tokens, and each
   distinct pre-token of the block becomes one row (word, block, index): the exploded positions, aggregated
   before the shuffle. A word that is a tenth of all tokens is one row a block.
2. The rows are shuffled by word and sorted, so each distinct word meets in one place and is encoded once.
3. The ids go back to the block they belong to. There the positions (for each document the indexes of its
   pre-tokens, in order) pick the ids, and the token sequences of the documents are put together again.

Positions are worked out twice from the input, for the words and for the reassembly, so neither texts nor
positions travel with the words. Blocks are named by the Spark partition and a running number and need an
input that is read the same way again, such as a table of files.

Decoding replaces each id by its bytes from the token table, which has a fixed size of some 50,000 rows.

Defined cases: a null text is an empty text and has no tokens; rows are encoded one by one, also repeated ones
and those without doc_id; an id that the table does not have cannot be decoded and raises. Empty tables give
empty tables; further columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from clipatlas.llm import vocabulary

#: Characters of text after which a block is closed.
BLOCK_CHARS = 1 << 24
_ROWS = 50_000
_IDS_AT_A_TIME = 1 << 20
#: Words that wait in a task until they are packed, and documents that are decoded at a time.
_WAITING, _DOCUMENTS = 200_000, 500


class _Indexes(dict):
    """pre-token -> its index in the block, by first occurrence."""

    def __missing__(self, word: str) -> int:
        index = self[word] = len(self)
        return index


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int) -> Iterator[tuple[int, list, list[np.ndarray], _Indexes]]:
    """block name, doc_ids, positions of each document, indexes: for each block of this task."""
    import regex

    cut = regex.compile(pattern)
    name, ids, positions, indexes, size = 0, [], [], _Indexes(), 0
    for batch in batches:
        if batch.num_rows and not name:
            name = (batch.column("part")[0].as_py() << 32) + 1
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            found = cut.findall(text)
            ids.append(doc_id)
            positions.append(np.fromiter(map(indexes.__getitem__, found), np.uint32, len(found)))
            size += len(text)
            if size >= block_chars:
                yield name, ids, positions, indexes
                name += 1
                ids, positions, indexes, size = [], [], _Indexes(), 0
    if ids:
        yield name, ids, positions, indexes


def _words(pattern: str, block_chars: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, _, indexes in _blocks(batches, pattern, block_chars):
            words = list(indexes)
            for begin in range(0, len(words), _ROWS):
                part = [w.encode("utf-8", "surrogatepass") for w in words[begin : begin + _ROWS]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array(np.full(len(part), name)), pa.array(np.arange(begin, begin + len(part), dtype=np.int32))],
                    ["word", "block", "index"],
                )

    return task


def _encoded(sent: Broadcast, pattern: str):
    """Rows of one word stand together; its ids are worked out at the first. Out go packed rows, many words each."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoder(sent, pattern)
        word, ids = None, b""
        waiting: dict[int, tuple[array, array, bytearray]] = {}
        held = 0
        for batch in batches:
            for next_word, block, index in zip(*(batch.column(c).to_pylist() for c in ("word", "block", "index")), strict=True):
                if next_word != word:
                    word = next_word
                    ids = np.array(encoding.encode_ordinary(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                rows = waiting.get(block)
                if rows is None:
                    rows = waiting[block] = array("I"), array("I"), bytearray()
                rows[0].append(index)
                rows[1].append(len(ids) // 4)
                rows[2].extend(ids)
                held += 1
            if held >= _WAITING:
                yield from _packed(waiting)
                waiting, held = {}, 0
        yield from _packed(waiting)

    return task


def _packed(waiting: dict[int, tuple[array, array, bytearray]]) -> Iterator[pa.RecordBatch]:
    """For each block one row: its indexes, the number of ids of each, and the ids, compressed."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    for block, rows in waiting.items():
        index, counts, ids = (np.frombuffer(x, "<u4") for x in rows)
        order = np.argsort(index)
        indexes, starts, counts = index[order], (np.cumsum(counts, dtype=np.int64) - counts)[order], counts[order]
        flat = ids[_runs(starts, counts)]
        steps = np.diff(indexes, prepend=np.uint32(0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block]), pa.array([0], pa.int32()), pa.array([len(indexes)], pa.int32()), pa.array([None], pa.list_(pa.int64())),
                pa.array([squeeze(_planes(steps) + _planes(counts) + _planes(flat))], pa.binary()), pa.array([len(flat)], pa.int64()),
            ],
            _NAMES,
        )


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers with their lowest bytes first, then the second bytes and so on: they compress better."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: memoryview, count: int) -> np.ndarray:
    return np.frombuffer(data[: 4 * count], np.uint8).reshape(4, count).T.copy().view("<u4").reshape(-1)


_NAMES = ["block", "kind", "n", "doc_ids", "data", "total"]
_SCHEMA = "block long, kind int, n int, doc_ids array<long>, data binary, total long"


def _positions(pattern: str, block_chars: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for name, ids, positions, indexes in _blocks(batches, pattern, block_chars):
            counts = np.array([len(p) for p in positions], np.uint32)
            flat = np.concatenate(positions)
            # Frequent words get small numbers: the renumbering travels with the positions.
            used = np.bincount(flat, minlength=len(indexes)) if len(flat) else np.zeros(0, np.int64)
            order = np.argsort(-used, kind="stable").astype(np.uint32)
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            data = squeeze(_planes(counts) + _planes(order) + _planes(rank[flat]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name]), pa.array([1], pa.int32()), pa.array([len(order)], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()), pa.array([len(flat)], pa.int64()),
                ],
                _NAMES,
            )

    return task


def _reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block stand together, its ids before its positions."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    block, parts = None, []
    for batch in batches:
        for at in range(batch.num_rows):  # a batch holds many blocks, which are expanded one at a time
            row = {name: batch.column(name)[at] for name in _NAMES}
            name, kind, n, total = (row[x].as_py() for x in ("block", "kind", "n", "total"))
            if name != block:
                block, parts = name, []
            data = memoryview(expand(row["data"].as_buffer()))
            if kind == 0:
                index = np.cumsum(_from_planes(data, n), dtype=np.uint32)
                parts.append((index, _from_planes(data[4 * n :], n), _from_planes(data[8 * n :], total)))
                continue
            yield from _documents(row["doc_ids"].as_py(), parts, data, n, total)
            block, parts = None, []


def _documents(doc_ids: list, parts: list, data: memoryview, words: int, total: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(words, np.int64)
    for index, count, _ in parts:
        counts[index] = count
    starts = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), "<u4")
    for index, count, flat in parts:
        ids[_runs(starts[index], count)] = flat
    docs = len(doc_ids)
    lengths = _from_planes(data, docs).astype(np.int64)
    order = _from_planes(data[4 * docs :], words)
    positions = order[_from_planes(data[4 * (docs + words) :], total)]
    ends = np.cumsum(lengths)
    at = 0
    while at < docs:  # some documents at a time, so that the ids of a block are never expanded at once
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - lengths[at] + _IDS_AT_A_TIME)))
        begin = int(ends[at] - lengths[at])
        part = positions[begin : int(ends[stop - 1])]
        expanded = ids[_runs(starts[part], counts[part])]
        cuts = np.concatenate([[0], np.cumsum(counts[part])])[np.concatenate([[begin], ends[at:stop]]) - begin]
        arrays = [expanded[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids[at:stop], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(arrays, pa.binary())], ["doc_id", "n_tokens", "ids"]
        )
        at = stop


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run of ``counts`` numbers, one after the other."""
    counts = counts.astype(np.int64)
    return np.repeat(starts.astype(np.int64) - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def encode(docs: DataFrame, sent: Broadcast, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit numbers) for every row of ``docs``, whole texts.

    A task holds a block; with a smaller ``block_chars`` it needs less memory, and more rows are shuffled.
    """
    # The partition of the input, also where a union numbers the tasks anew.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.spark_partition_id().alias("part"))
    words = texts.mapInArrow(_words(pattern, block_chars), "word binary, block long, index int")
    ids = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encoded(sent, pattern), _SCHEMA)
    positions = texts.mapInArrow(_positions(pattern, block_chars), _SCHEMA)
    return (
        ids.unionByName(positions).repartition("block").sortWithinPartitions("block", "kind")
        .mapInArrow(_reassembled, "doc_id long, n_tokens long, ids binary")
    )


def decode(encoded: DataFrame, sent: Broadcast, column: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with ``decoded`` (bytes): the bytes of each id, joined with the token table by id."""
    names = [c for c in encoded.columns if c != "decoded"]
    encoded = encoded.select(names)
    place = names.index(column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.ranks(sent.value)
        lengths = np.full(max(table.values()) + 1, -1, np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
        flat = np.empty(int(np.maximum(lengths, 0).sum()), np.uint8)
        for token, rank in table.items():
            flat[starts[rank] : starts[rank] + len(token)] = np.frombuffer(token, np.uint8)

        def decoded(data: bytes | None) -> bytes | None:
            if data is None:
                return None
            ids = np.frombuffer(data, "<u4")
            out = []
            for begin in range(0, len(ids), _IDS_AT_A_TIME):
                part = ids[begin : begin + _IDS_AT_A_TIME]
                if len(part) and (part.max() >= len(lengths) or lengths[part].min() < 0):
                    raise ValueError("an id that the token table does not have")
                out.append(flat[_runs(starts[part], lengths[part])].tobytes())
            return b"".join(out)

        for batch in batches:
            for at in range(0, batch.num_rows, _DOCUMENTS):  # so that a batch is never decoded whole
                part = batch.slice(at, _DOCUMENTS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([decoded(x.as_py()) for x in part.column(place)], pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(task, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
