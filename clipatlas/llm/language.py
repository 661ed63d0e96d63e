"""Language by compression: the language whose dictionary shortens a text most.

For each language a raw-content zstandard dictionary is filled with text of that language. A text is
compressed with every dictionary; the smallest result names the language. The gain of a dictionary is
what it saves against compression without one (letters only, case is not looked at), and the score is the lead of the best gain over the
second, as a share of the best: a narrow lead is a rejection.

Defined cases: a null text or one without a letter is ``und`` with score 0. Equal sizes are decided by
the name of the language. With a single language learned, its score is 1. Rows of the training table
without text or language are not learned from; with nothing to learn every row is ``und``. Repeated
rows get equal answers, further columns are not looked at, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The bounded sample that is learned from: documents of a language, and characters of each.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 100, 1200
#: Bytes of a text that are compressed at a time; the dictionary counts anew for each piece.
PIECE_BYTES = 1 << 14
LEVEL = 6
#: A lead under this share of the best gain is narrow.
NARROW = 0.05


def learn_dictionaries(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """What fills the dictionary for each ``lang`` of ``docs``, from at most ``documents`` rows of it, the first by hash.

    What reaches the driver is bounded by the number of languages times both parameters. The ranking is cut
    in every task before the shuffle, so a language with a third of all rows costs no more than others.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    sample = (
        known.select("lang", "doc_id", F.substring("text", 1, chars).alias("text"))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= documents)
        .select("lang", "place", "text")
    )
    texts: dict[str, list[tuple[int, str]]] = {}
    for row in sample.toLocalIterator():
        texts.setdefault(row["lang"], []).append((row["place"], row["text"]))
    return {lang: "\n".join(t for _, t in sorted(rows)).lower() for lang, rows in sorted(texts.items())}


def _classifier(dictionaries: dict[str, str]):
    """text -> (language, score, rejected), for one task."""
    import regex
    import zstandard as z

    letter, other = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")
    plain = z.ZstdCompressor(level=LEVEL)
    learned = []
    for lang, sample in dictionaries.items():
        content = other.sub(" ", sample).encode("utf-8", "surrogatepass")
        ready = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        ready.precompute_compress(level=LEVEL)
        learned.append((lang, z.ZstdCompressor(level=LEVEL, dict_data=ready)))

    def classify(text: str | None, narrow: float) -> tuple[str, float, bool]:
        if text is None or not learned or not letter.search(text):
            return "und", 0.0, True
        data = other.sub(" ", text.lower()).encode("utf-8", "surrogatepass")
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        base = sum(len(plain.compress(p)) for p in pieces)
        gains = sorted((sum(len(c.compress(p)) for p in pieces) - base, lang) for lang, c in learned)
        best, lang = gains[0]
        if len(gains) == 1:
            return lang, 1.0, False
        lead = gains[1][0] - best
        score = min(1.0, lead / -best) if best < 0 else 0.0
        return lang, score, score < narrow

    return classify


def identify(spark: SparkSession, docs: DataFrame, dictionaries: dict[str, str], narrow: float = NARROW) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs``. No shuffle; the dictionaries go to the tasks."""
    sent = spark.sparkContext.broadcast(dictionaries)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = _classifier(sent.value)
        for batch in batches:
            found = [classify(t.as_py(), narrow) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.bool_()),
                ],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double, rejected boolean")


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds
