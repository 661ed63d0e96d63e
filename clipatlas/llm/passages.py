"""Repeated passages, removed by unit hashing and by windows of words.

A unit is a line, cut further after a full stop, exclamation or question mark that white space follows. Units
are normalised (lower case, runs of white space as one space) and hashed to 96 bits. Digests are grouped over
all documents; the earliest occurrence, by doc_id and then place, stays. The others are marked, and a run of
marked units next to each other is removed if it has ``MIN_WORDS`` words or more: single short sentences repeat
by chance and stay.

Units depend on what surrounds a passage, so windows do the rest: every run of ``MIN_WORDS`` words, wherever it
begins, that an earlier document has word for word, or the same document without overlap before, is marked as
well, and all words under marked windows are removed. A character of a script without blanks is a word there.

The texts are read twice and never shuffled. Each window is stood for by the smallest hash of the shorter runs of
words in it (winnowing), which neighbouring windows share; windows next to each other with one such hash are a
stretch. Equal windows have equal hashes, and only hashes that occur more than once are looked at further. Where
all stretches of a hash are equal, a stretch is a row; where they differ, at the ends of passages, each of its
windows is. Rows are compared by 96 bits. What occurs more than once is told by bitmaps of fixed size, which
only let too much through.

Offsets are code points of the original text. Defined cases: a null or empty text has no units and stays as
it is; rows equal in doc_id and text are one document and lose the same spans; rows without doc_id rank
last; a run may be the whole text, which then is empty. Empty tables give empty tables; further columns pass
through ``without_repeats`` and are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Words that a run of repeated units must have to be removed.
MIN_WORDS = 25
#: Bits of the map of hashes that occur again. With many more of them it lets more through, and only costs time.
_MAP_BITS = 1 << 25
_ROWS_AT_A_TIME = 20_000
#: ``place`` and ``upto`` are the first and last word of units, and the first and last window. The words between blanks, ``word`` up to
#: before ``after``, are named only if they do not follow from these, in scripts without blanks.
_ROWS = "doc_id long, version long, whole boolean, place int, upto int, start int, stop int, word int, after int, d0 long, d1 int, again boolean"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 6, pa.int64(), pa.int32(), pa.bool_()]
_LAST = (1 << 63) - 1
#: What is shuffled of the hash of a unit or stretch and of what tells stretches apart.
_SHORT = np.uint64((1 << 40) - 1)
#: Keeps units apart from runs of as many words.
_UNIT = np.uint64(0xA0761D6478BD642F)
#: By code point; none beyond is white space.
_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
#: Thai to Khmer and Chinese, Japanese: scripts that put no blanks between words.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+"
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Words are hashed so many at a time, and those that are longer than so many characters each by itself.
_WORDS_AT_A_TIME, _CHARS = 1 << 14, 64


def _version(text: Column) -> Column:
    return F.crc32(text)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _between_blanks(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and stop."""
    blank = np.ones(len(codes) + 2, bool)
    blank[1:-1] = _BLANK[codes if codes.dtype == np.uint8 else np.minimum(codes, len(_BLANK) - 1)]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _characters(codes: np.ndarray, places: np.ndarray, base: int) -> np.ndarray:
    """A hash of each character at its place in a word."""
    return _mixed((codes.astype(np.uint64) * np.uint64(_CHARS) + places.astype(np.uint64) + np.uint64(1)) * np.uint64(base))


_ASCII = [_characters(np.arange(128).repeat(_CHARS), np.tile(np.arange(_CHARS), 128), b) for b in _BASES]


def _word_hashes(lower: str, codes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each word of a text in lower case."""
    hashes = [np.empty(len(starts), np.uint64) for _ in _BASES]
    for at in range(0, len(starts), _WORDS_AT_A_TIME):
        part = slice(at, at + _WORDS_AT_A_TIME)
        size = np.minimum(stops[part] - starts[part], _CHARS)
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        code = codes[np.repeat(starts[part], size) + place]
        for i, base in enumerate(_BASES):
            values = _ASCII[i][code.astype(np.int64) * _CHARS + place] if codes.dtype == np.uint8 else _characters(code, place, base)
            hashes[i][part] = _mixed(np.add.reduceat(values, first))
    long = np.flatnonzero(stops - starts > _CHARS)
    if len(long):
        import xxhash

        for word in long.tolist():
            digest = xxhash.xxh3_128_intdigest(lower[starts[word] : stops[word]].encode("utf-8", "surrogatepass"))
            hashes[0][word], hashes[1][word] = digest >> 64, digest & 0xFFFFFFFFFFFFFFFF
    return hashes


class _Runs:
    """Hashes of runs of words, from sums over all words before a place."""

    def __init__(self, base: int) -> None:
        self.bases = base, pow(base, -1, 1 << 64)
        self.powers = np.ones((2, 1), np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        while self.powers.shape[1] <= len(hashes):
            n = self.powers.shape[1]
            ahead = np.array([[pow(b, n, 1 << 64)] for b in self.bases], np.uint64)
            self.powers = np.concatenate([self.powers, self.powers * ahead], axis=1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[0, : len(hashes)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = (stop - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return _mixed((sums[stop] - sums[start]) * self.powers[1, start] + size)


def _sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values, have = of(values[:-step], values[step:]), have + step
    return values


class _Text:
    """Where the words between blanks, the units and the tokens of a text are; ``ends`` are the words after the units."""

    def __init__(self, text: str) -> None:
        codes = _codes(text)
        self.starts, self.stops = _between_blanks(codes)
        n = len(self.starts)
        if not n:
            self.begins = self.ends = self.unit_starts = self.unit_stops = self.starts
            return
        # A unit ends before white space that has a newline or follows a full stop, exclamation or question mark.
        last = codes[self.stops - 1]
        cut = np.concatenate([[False], (last == 46) | (last == 33) | (last == 63)])
        cut[np.searchsorted(self.starts, np.flatnonzero(codes == 10))] = True
        self.begins = np.flatnonzero(np.concatenate([[True], cut[1:-1]]))
        self.ends = np.append(self.begins[1:], n)
        self.unit_starts, self.unit_stops = self.starts[self.begins], self.stops[self.ends - 1]
        if not cut[0]:
            self.unit_starts[0] = 0
        if not cut[-1]:
            self.unit_stops[-1] = len(codes)


class _Reader:
    """Units and windows of texts, for one task."""

    def __init__(self, min_words: int, whole: bool) -> None:
        import re

        self.min_words, self.whole = min_words, whole
        self.run = (min_words + 1) // 2
        self.token, self.unspaced = re.compile(_TOKEN), re.compile(f"[{_UNSPACED}]")
        self.runs = [_Runs(b) for b in _BASES]

    def _sums(self, lower: str) -> list[np.ndarray]:
        codes = _codes(lower)
        return [r.sums(h) for r, h in zip(self.runs, _word_hashes(lower, codes, *_between_blanks(codes)), strict=True)]

    def read(self, text: str) -> None:
        """``sums`` over the two hashes of words between blanks, and ``tokens`` over those of tokens, whose ``spans`` are None if they are the same."""
        self.sums = self._sums(text.lower())
        self.spans, self.tokens = None, self.sums
        if self.whole and not text.isascii() and self.unspaced.search(text):
            self.spans = np.array([m.span() for m in self.token.finditer(text)], np.int64).reshape(-1, 2)
            self.tokens = self._sums(" ".join(text[a:b].lower() for a, b in self.spans.tolist()))

    def units(self, at: _Text) -> list[np.ndarray]:
        """Two hashes of each unit."""
        first, second = (r.of(s, at.begins, at.ends) for r, s in zip(self.runs, self.sums, strict=True))
        return [first ^ _UNIT, second]

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch the hash, the first window and the window after the last."""
        n = len(self.tokens[0]) - 1
        if not self.whole or n < self.min_words:
            none = np.zeros(0, np.int64)
            return none.view(np.uint64), none, none
        start = np.arange(n - self.run + 1)
        least = _sliding(self.runs[0].of(self.tokens[0], start, start + self.run), self.min_words - self.run + 1)
        begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return least[begins], begins, np.append(begins[1:], len(least))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            if text:
                yield doc_id, text


def _hashes(batches: Iterator[pa.RecordBatch], min_words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """The hash of each unit and stretch, and for stretches what tells them apart."""
    reader = _Reader(min_words, whole)
    parts: list[np.ndarray] = []
    held = 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((c & _SHORT).view(np.int64)) for c in np.concatenate(parts, axis=1)], ["hash", "content"])

    for _, text in _texts(batches):
        reader.read(text)
        least, begins, ends = reader.stretches()
        if len(least):
            content = reader.runs[0].of(reader.tokens[0], begins, ends + min_words - 1)
            parts.append(np.stack([least, content]))
            long = ends - begins >= min_words  # may hold a passage that follows itself
            if long.any():
                parts.append(np.stack([least[long], ~content[long]]))
                held += parts[-1].shape[1]
        units = reader.units(_Text(text))[0]
        parts.append(np.stack([units, np.zeros_like(units)]))
        held += len(least) + len(units)
        if held >= _ROWS_AT_A_TIME:
            yield full()
            parts.clear()
            held = 0
    if parts:
        yield full()


def _repeated_hashes(docs: DataFrame, min_words: int, whole: bool) -> np.ndarray:
    """Two bitmaps: the hashes that occur more than once, and those of them with stretches that differ."""
    rows = docs.mapInArrow(lambda batches: _hashes(batches, min_words, whole), "hash long, content long")
    differ = F.min("content") != F.max("content")
    twice = rows.groupBy("hash").agg(F.count("*").alias("n"), differ.alias("differ")).where(F.col("n") > 1)
    bit, one = F.col("hash").bitwiseAND(_MAP_BITS - 1), F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    words = (
        twice.select(F.shiftright(bit, 6).cast("int").alias("word"), one.alias("bit"), F.when(F.col("differ"), one).otherwise(F.lit(0).cast("long")).alias("edge"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"), F.bit_or("edge").alias("edges"))
    )
    bitmaps = np.zeros((2, _MAP_BITS // 64), np.uint64)
    for row in words.toLocalIterator():  # at most the words of the map
        bitmaps[:, row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF, row["edges"] & 0xFFFFFFFFFFFFFFFF
    return bitmaps


def _held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(_MAP_BITS - 1)
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _rows(batches: Iterator[pa.RecordBatch], bitmaps: np.ndarray, min_words: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Units, stretches and windows whose hash occurs again; those next to each other that their text had before are one row."""
    from zlib import crc32

    names = [c.split()[0] for c in _ROWS.split(", ")]
    reader = _Reader(min_words, whole)
    parts: list[list[np.ndarray]] = []
    held = 0

    def full() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        missing = columns[names.index("after")] < 0
        arrays = [pa.array(c, k, mask=missing if n in ("word", "after") else None) for n, c, k in zip(names, columns, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    def add(of: tuple[int, int, bool], place, upto, start, stop, word, after, d0, d1, again) -> int:
        joined = np.zeros(len(place), bool)
        joined[1:] = again[1:] & again[:-1] & (upto[:-1] == place[1:] - 1)
        first = np.flatnonzero(~joined)
        last = np.append(first[1:], len(place)) - 1
        columns = [place[first], upto[last], start[first], stop[last], word[first], after[last], d0[first].view(np.int64), (d1[first] >> np.uint64(32)).astype(np.uint32).view(np.int32), again[first]]
        parts.append([*(np.full(len(first), x) for x in of), *columns])
        return len(first)

    for doc_id, text in _texts(batches):
        reader.read(text)
        at, version = _Text(text), crc32(text.encode("utf-8", "surrogatepass"))
        units = reader.units(at)
        some = np.flatnonzero(_held(bitmaps[0], units[0]))
        if len(some):
            d0, d1 = (u[some] for u in units)
            _, earlier, of = np.unique(d0, return_index=True, return_inverse=True)
            none = np.full(len(some), -1)
            held += add((doc_id, version, False), at.begins[some], at.ends[some] - 1, at.unit_starts[some], at.unit_stops[some], none, none, d0, d1, earlier[of] < np.arange(len(some)))
        least, begins, ends = reader.stretches()
        twice, edge = _held(bitmaps[0], least), _held(bitmaps[1], least)
        if twice.any():
            size = np.where(edge, ends - begins, 1)[twice]
            first = np.repeat(begins[twice], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            upto = np.where(np.repeat(edge[twice], size), first, np.repeat(ends[twice] - 1, size))
            d0, d1 = (r.of(s, first, upto + min_words) for r, s in zip(reader.runs, reader.tokens, strict=True))
            _, earlier, of = np.unique(d0, return_index=True, return_inverse=True)
            again = first - first[earlier][of] >= min_words
            stop = upto + min_words - 1
            starts, stops = (at.starts, at.stops) if reader.spans is None else reader.spans.T
            word = after = np.full(len(first), -1)
            if reader.spans is not None:
                # The number of the word between blanks.
                word, after = (np.searchsorted(at.starts, starts[x], "right") - 1 for x in (first, stop))
                after += 1
            held += add((doc_id, version, True), first, upto, starts[first], stops[stop], word, after, d0, d1, again)
        if held >= _ROWS_AT_A_TIME:
            whole_batch = full()
            yield from (whole_batch.slice(i, _ROWS_AT_A_TIME) for i in range(0, whole_batch.num_rows, _ROWS_AT_A_TIME))
            parts.clear()
            held = 0
    if parts:
        yield full()


#: Bits of each number in ``low`` and the others in ``high``, which is 0 for texts of common length.
_BITS = {"whole": (1, 0), "again": (1, 0), "further": (8, 23), "place": (16, 15), "start": (20, 11), "size": (16, 15)}


def _packed(units: DataFrame) -> DataFrame:
    """Rows with their numbers in two longs and, in scripts without blanks, a third: they take less room where they are shuffled."""
    numbers = units.withColumns({"further": F.col("upto") - F.col("place"), "size": F.col("stop") - F.col("start")})
    low = high = F.lit(0).cast("long")
    low_at = high_at = 0
    for name, (bits, others) in _BITS.items():
        number = F.col(name).cast("long")
        low = low.bitwiseOR(F.shiftleft(number.bitwiseAND((1 << bits) - 1), low_at))
        high = high.bitwiseOR(F.shiftleft(F.shiftright(number, bits), high_at)) if others else high
        low_at, high_at = low_at + bits, high_at + others
    words = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.col("after").cast("long"))
    return numbers.select("doc_id", "version", "d0", "d1", low.alias("low"), high.alias("high"), words.alias("words"))


def _unpacked(packed: DataFrame, *others: str) -> DataFrame:
    part = lambda c, at, bits: F.shiftrightunsigned(c, at).bitwiseAND((1 << bits) - 1)
    numbers, low_at, high_at = {}, 0, 0
    for name, (bits, more) in _BITS.items():
        upper = F.shiftleft(part("high", high_at, more), bits) if more else F.lit(0).cast("long")
        numbers[name] = part("low", low_at, bits).bitwiseOR(upper).cast("int")
        low_at, high_at = low_at + bits, high_at + more
    return packed.select(
        "doc_id", "version", (numbers["whole"] == 1).alias("whole"),
        numbers["place"].alias("place"), (numbers["place"] + numbers["further"]).alias("upto"),
        numbers["start"].alias("start"), (numbers["start"] + numbers["size"]).alias("stop"),
        part("words", 32, 31).cast("int").alias("word"), part("words", 0, 31).cast("int").alias("after"), *others,
    )


def _runs(spark: SparkSession, docs: DataFrame, folder: str, min_words: int, whole: bool) -> DataFrame:
    """doc_id, version, start, stop, word, words, first_doc_id of the runs of marked units and, if ``whole``, of marked windows.

    A digest is a row for each task in the grouping, whatever its number of occurrences, and the join back can be
    split, so a line that a third of the documents share is no hot task.
    """
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(_repeated_hashes(narrow, min_words, whole))
    narrow.mapInArrow(lambda batches: _rows(batches, sent.value, min_words, whole), _ROWS).write.option("compression", "zstd").parquet(f"{folder}/units")
    units = spark.read.parquet(f"{folder}/units")
    # Of a unit that a document repeats only the first can be the earliest, so the smallest doc_id decides.
    earliest = (
        units.where(~F.col("again")).groupBy("d0", "d1")
        .agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
        .where(F.col("first_doc_id") != F.col("last_doc_id"))
        .select("d0", "d1", "first_doc_id")
    )
    other = F.col("first_doc_id").isNotNull() & (F.col("doc_id") != F.col("first_doc_id"))
    again = F.col("low").bitwiseAND(2) == 2
    found = (
        _packed(units).join(earliest, ["d0", "d1"], "left").where(again | other)
        .select("doc_id", "version", F.coalesce("first_doc_id", "doc_id").alias("first_doc_id"), "low", "high", "words")
        .repartition("doc_id", "version")
    )
    marked = _unpacked(found, "first_doc_id").dropDuplicates(["doc_id", "version", "whole", "place"])
    in_text = Window.partitionBy("doc_id", "version", "whole").orderBy("place")
    reach = F.when(F.col("whole"), min_words).otherwise(1)
    apart = F.coalesce(F.lag("upto").over(in_text) + reach < F.col("place"), F.lit(True))
    word, after = F.coalesce("word", "place"), F.coalesce("after", F.col("upto") + reach)
    runs = marked.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(in_text))
    return (
        runs.groupBy("doc_id", "version", "whole", "run")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(word).alias("word"),
            (F.max(after) - F.min(word)).alias("words"), F.min_by("first_doc_id", "place").alias("first_doc_id"),
        )
        .where(F.col("whole") | (F.col("words") >= min_words))
    )


def _shown(runs: DataFrame) -> DataFrame:
    named = lambda c: F.when(F.col(c) != _LAST, F.col(c)).alias(c)
    return runs.select(named("doc_id"), "version", "start", "stop", F.col("words").cast("long").alias("words"), named("first_doc_id"))


def repeated_spans(spark: SparkSession, docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """Like ``whole_repeats``, by the runs of units alone."""
    return _shown(_runs(spark, docs, folder, min_words, whole=False))


def whole_repeats(spark: SparkSession, docs: DataFrame, folder: str, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version, start, stop, words, first_doc_id: what ``without_repeats`` removes, one row for each span.

    ``version`` tells texts apart that share a doc_id; ``first_doc_id`` is the document that keeps the first unit
    or window of the span. ``words`` counts between blanks. Runs of units and of windows that overlap are one span.
    """
    in_text = Window.partitionBy("doc_id", "version").orderBy("start", "stop", "whole")
    before = in_text.rowsBetween(Window.unboundedPreceding, -1)
    runs = _runs(spark, docs, folder, min_words, whole=True)
    apart = F.coalesce(F.max("stop").over(before) < F.col("start"), F.lit(True))
    spans = runs.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(in_text))
    return _shown(
        spans.groupBy("doc_id", "version", "span").agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"),
            (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"), F.min_by("first_doc_id", F.struct("start", "stop", "whole")).alias("first_doc_id"),
        )
    )


def unused_names(docs: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    return [next(n for n in (f"{'_' * i}{name}" for i in range(len(taken) + 1)) if n.lower() not in taken) for name in names]


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text``, with the white space after them; ``n_chars`` follows if there. All rows stay."""
    row_id, row_version, found = unused_names(docs, "_id", "_version", "_spans")
    lists = spans.groupBy(F.coalesce("doc_id", F.lit(_LAST)).alias(row_id), F.col("version").alias(row_version)).agg(
        F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(found)  # at most the units of one text
    )
    keyed = docs.withColumn(row_id, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(row_version, _version(F.coalesce("text", F.lit(""))))
    joined = keyed.join(lists, [row_id, row_version], "left").select(*docs.columns, found)
    names, place = docs.columns, docs.columns.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts, counts = [], []
            old = columns[counted].to_pylist() if counted is not None else [None] * batch.num_rows
            for text, spans, count in zip(batch.column(place), batch.columns[-1], old, strict=True):
                text, spans = text.as_py(), spans.as_py()
                if spans:
                    kept, at = [], 0
                    for span in spans:
                        kept.append(text[at : span["start"]])
                        at = span["stop"]
                        while at < len(text) and text[at].isspace():
                            at += 1
                    text = "".join([*kept, text[at:]])
                    count = len(text)
                texts.append(text)
                counts.append(count)
            columns[place] = pa.array(texts, columns[place].type)
            if counted is not None:
                columns[counted] = pa.array(counts, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = [StructField("n_chars", LongType()) if f.name == "n_chars" else f for f in docs.schema.fields]
    cast = joined.withColumn("n_chars", F.col("n_chars").cast("long")) if counted is not None else joined
    return cast.mapInArrow(task, StructType(fields))
