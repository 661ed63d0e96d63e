"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact containment.

A text is lower-cased and cut into words at white space; its shingles are runs of five words (one shorter run
if there are fewer words). Documents are partitioned by their number of shingles in powers of two, and the
sketch of a partition has a number of minima in proportion to its size: the hash range is cut into bins, and
the smallest hash of a document in each bin is kept. An item is sketched with the bins of each partition. A
shingle that both hold is found if neither has a smaller one in its bin, whatever the length of the document;
the number of bins is set so that an item of the smallest size at the threshold is missed with a probability
of at most ``MISS``. Equal minima give candidates, and candidates are confirmed by counting the item's
shingles, as text, in the whole document.

Everything is a column expression or a DataFrame operation. Defined cases: a null text, an empty text and an
item without words contain nothing and are contained in nothing. Rows that share a doc_id are one document,
rows that share an item_id one item, and null ids are ids like others. Empty tables give empty tables; columns
other than those named are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 5
#: Share of an item's shingles that a document must hold.
THRESHOLD = 0.75
#: Probability to miss an item at the threshold.
MISS = 1e-7
#: Item shingles up to this number are broadcast (some 50 MB); more are joined by a shuffle.
_BROADCAST_ROWS = 500_000
_BLANKS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text; an array of one empty string if there are none."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(_BLANKS)), "[\\x20\\x09-\\x0D]+")


def _shingled(words_name: str, one: str) -> Column:
    """``one`` for each run of SIZE words, where w(j) stands for word i + j; a shorter text is one run."""
    expression = one
    for j in range(SIZE):
        expression = expression.replace(f"w({j})", f"get({words_name}, i + {j})")
    return F.expr(
        f"CASE WHEN size({words_name}) = 1 AND {words_name}[0] = '' THEN slice(array({_one_run(words_name, one)}), 1, 0) "
        f"WHEN size({words_name}) < {SIZE} THEN array({_one_run(words_name, one)}) "
        f"ELSE transform(sequence(0, size({words_name}) - {SIZE}), i -> {expression}) END"
    )


def _one_run(words_name: str, one: str) -> str:
    joined = f"array_join({words_name}, ' ')"
    return f"xxhash64({joined})" if one.startswith("xxhash64") else joined


def shingle_hashes(words_name: str) -> Column:
    return _shingled(words_name, "xxhash64(w(0), w(1), w(2), w(3), w(4))")


def shingle_texts(words_name: str) -> Column:
    return _shingled(words_name, "concat_ws(' ', w(0), w(1), w(2), w(3), w(4))")


def bins_per_shingle(smallest: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """log2 of the bins for each shingle of a partition. One of d shingles in a bin is its minimum with 1/d at least."""
    found = max(1, math.ceil(threshold * smallest))
    crowd = 2 * miss ** (1 / found)  # mean number of other shingles in a bin; half of them are smaller
    return max(0, math.ceil(math.log2(1 / crowd)))


def _item_shingles(items: DataFrame) -> DataFrame:
    """item_id, shingle (text), hash, and the next smaller hash of the item: one row for each distinct shingle."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).select("item_id", shingle_texts("w").alias("shingle"), shingle_hashes("w").alias("hash"))
    rows = cut.select("item_id", F.inline(F.arrays_zip("shingle", "hash"))).distinct()
    return rows.withColumn("smaller", F.lag("hash").over(Window.partitionBy("item_id").orderBy("hash")))


def contained_items(spark: SparkSession, docs: DataFrame, items: DataFrame, folder: str, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment of every item that a document of ``docs`` holds.

    ``docs`` has doc_id and text, ``items`` item_id and text. The driver sees the number of item shingles and
    the smallest item. A document sends only the minima that an item has too, and only candidates are read again.
    """
    shingles = _item_shingles(items)
    shingles.write.parquet(f"{folder}/items")
    shingles = spark.read.parquet(f"{folder}/items")
    sizes = shingles.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    measured = sizes.agg(F.sum("item_shingles").alias("rows"), F.min("item_shingles").alias("smallest")).first()
    small = (measured["rows"] or 0) <= _BROADCAST_ROWS
    sent = F.broadcast if small else (lambda rows: rows)
    fine = bins_per_shingle(measured["smallest"] or 1, threshold)

    hashed = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.sort_array(shingle_hashes("w")).alias("hashes"))
    # unused: the low bits of a hash that do not name a bin. No filter on the arrays here: it would be pushed below
    # them, and the words be cut anew for each shingle. Texts without shingles explode to nothing.
    partitioned = hashed.select(
        "doc_id", "hashes", F.greatest(F.lit(1), 64 - F.least(F.lit(63), F.ceil(F.log2(F.size("hashes"))).cast("int") + fine)).alias("unused")
    )
    minima = partitioned.select(
        "doc_id", "unused",
        F.explode(F.expr("filter(hashes, (x, i) -> i = 0 OR shiftright(x, unused) != shiftright(hashes[i - 1], unused))")).alias("hash"),
    )
    candidates = (
        minima.join(sent(shingles.select("hash", "smaller", "item_id")), "hash")
        .where(F.col("smaller").isNull() | F.expr("shiftright(smaller, unused) != shiftright(hash, unused)"))
        .select("doc_id", "item_id").distinct()
    )
    candidates.write.parquet(f"{folder}/candidates")
    candidates = spark.read.parquet(f"{folder}/candidates")

    same = lambda a, b, name: a[name].eqNullSafe(b[name])
    wanted = candidates.select("doc_id").distinct()
    again = docs.select("doc_id", "text").alias("d").join(wanted.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left_semi")
    texts = again.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(shingle_texts("w"))).alias("shingle"))
    held = texts.join(sent(shingles.select("shingle", "item_id")), "shingle").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    confirmed = held.join(candidates, same(held, candidates, "doc_id") & same(held, candidates, "item_id"), "left_semi")
    return (
        confirmed.alias("h").join(sent(sizes).alias("s"), F.col("h.item_id").eqNullSafe(F.col("s.item_id")))
        .where(F.col("shared") >= threshold * F.col("item_shingles"))
        .select("h.doc_id", "h.item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))
    )
