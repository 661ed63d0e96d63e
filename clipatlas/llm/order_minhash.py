"""Order MinHash fingerprints of documents: signatures that follow the edit distance.

A text is cut into pieces: runs of up to eight characters that are not white space. Its k-mers are the pairs
of neighbouring pieces, the ends of the text included; equal k-mers are numbered by occurrence, so repeats
count. Each numbered k-mer has a 64-bit hash, whose upper bits deal it to one of ``BINS``. In each bin the two
smallest are selected and put back into the order of the text, and the hash of that tuple is the bin's entry.
The likeness of two fingerprints is the share of bins with equal entries among the bins either of them uses.

Everything is a column expression or a DataFrame operation. Hash and position of a k-mer share one 64-bit
number while they are sorted; the position takes as many bits as the text needs, so any length works.

Defined cases: a null text is an empty text; an empty text has the one k-mer of both ends. Rows that share a
doc_id are ordered by a hash of their text. A table of one row has itself as the next document. Rows without
doc_id come last. Empty tables give empty tables; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, _BIN_BITS = 64, 6
_PIECE = r"[^\\s]{1,8}"
_STEPS = ["_pieces", "_room", "_mask", "_kmers", "_starts", "_numbered", "_chosen", "_heads"]
#: Bounds of ranges that are looked through together.
_FAN = 64


def _kmer(position: str) -> str:
    return f"coalesce(get(_pieces, cast({position} - 1 AS int)), ''), coalesce(get(_pieces, cast({position} AS int)), '')"


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of column ``text`` as ``name``: an array with a number for each bin in use."""
    bin_of = lambda x: f"shiftright({x}, {64 - _BIN_BITS})"
    place = lambda x: f"({x} & _mask)"
    entry = f"shiftleft({bin_of('_chosen[i]')} & {BINS - 1}, 16) | (%s & 65535)"
    alone = f"xxhash64({_kmer(place('_chosen[i]'))})"
    first = f"least({place('_chosen[i]')}, {place('_chosen[i + 1]')})"
    second = f"greatest({place('_chosen[i]')}, {place('_chosen[i + 1]')})"
    both = f"xxhash64({_kmer(first)}, {_kmer(second)})"
    steps = {
        "_pieces": f"regexp_extract_all({text}, '{_PIECE}', 0)",
        "_room": "cast(ceil(log2(size(_pieces) + 2)) AS int) + 1",
        "_mask": "shiftleft(1L, _room) - 1",
        "_kmers": f"sort_array(transform(sequence(0, size(_pieces)), i -> (xxhash64({_kmer('i')}) & ~_mask) | i))",
        "_starts": "filter(sequence(0, size(_pieces)), i -> i = 0 OR shiftright(_kmers[i], _room) != shiftright(_kmers[i - 1], _room))",
        "_numbered": (
            "sort_array(flatten(transform(_starts, (s, d) -> transform(sequence(0, coalesce(get(_starts, d + 1), size(_kmers)) - s - 1), "
            f"o -> (xxhash64({_kmer(place('_kmers[s + o]'))}, o) & ~_mask) | {place('_kmers[s + o]')}))))"
        ),
        "_chosen": f"filter(_numbered, (x, i) -> i < 2 OR {bin_of('x')} != {bin_of('_numbered[i - 2]')})",
        "_heads": f"filter(sequence(0, size(_chosen) - 1), i -> i = 0 OR {bin_of('_chosen[i]')} != {bin_of('_chosen[i - 1]')})",
        name: (
            f"transform(_heads, i -> CASE WHEN i + 1 < size(_chosen) AND {bin_of('get(_chosen, i + 1)')} = {bin_of('_chosen[i]')} "
            f"THEN {entry % both} ELSE {entry % alone} END)"
        ),
    }
    kept = rows.columns
    for column, expression in steps.items():
        rows = rows.withColumn(column, F.expr(expression))
    return rows.select(*kept, name)


def as_text(fingerprint: Column) -> Column:
    """Six hexadecimal digits for each bin in use: two name the bin, four are its entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda f: F.transform(f, lambda x: F.shiftright(x, 16))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(bins(a), bins(b)))


def _range_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are larger than an id: its range, 0 for the largest ids."""
    if not bounds:
        return F.lit(0)
    whole = F.array(*[F.lit(b) for b in bounds])
    larger = lambda part: F.size(F.filter(part, lambda b: b > doc_id))
    if len(bounds) <= _FAN:
        return larger(whole)
    coarse = F.greatest(larger(F.array(*[F.lit(b) for b in bounds[::_FAN]])) - 1, F.lit(0)) * _FAN
    return coarse + larger(F.slice(whole, coarse + 1, _FAN))


def _id_bounds(docs: DataFrame, ranges: int) -> list[int]:
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * ranges).alias("bounds")).first()["bounds"]
    return sorted(set(found or []), reverse=True)


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text of a document has its last third replaced by the beginning of the next document, by
    descending doc_id. Neighbours meet through ``ranges`` ranges of ids with about as many rows each (as many
    as there are shuffle partitions, unless given): every text is shuffled once, and the first document of each
    range is copied to the end of the range before it. The driver sees the bounds of the ranges, and Spark sorts
    the numbers of the ranges, never the documents, in one place.
    """
    if ranges is None:
        ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    rows = rows.withColumn("_order", order).withColumn("_tie", F.xxhash64("text"))
    rows = rows.withColumn("_range", _range_of(F.col("_order"), _id_bounds(rows, ranges)))
    found = rows.groupBy("_range").agg(F.max("_order").alias("_order"))
    around = Window.orderBy("_range")  # a row for each range
    last = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = found.select("_order", "_range", F.coalesce(F.lag("_range").over(around), F.last("_range").over(last)).alias("_before"))
    at_first = Window.partitionBy("_range").orderBy("_tie")
    firsts = (
        rows.join(F.broadcast(before), ["_range", "_order"])  # ranges rows, a parameter
        .withColumn("_n", F.row_number().over(at_first)).where(F.col("_n") == 1)
        .select("doc_id", "text", "_order", "_tie", F.col("_before").alias("_range"), F.lit(True).alias("_copy"))
    )
    both = with_fingerprint(rows.withColumn("_copy", F.lit(False)).unionByName(firsts), "text", "_fingerprint")
    in_range = Window.partitionBy("_range").orderBy("_copy", F.desc("_order"), "_tie")
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    followed = (
        both.withColumn("_next", F.lead("text").over(in_range)).withColumn("_next_fingerprint", F.lead("_fingerprint").over(in_range))
        .where(~F.col("_copy"))
        .withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)))
        .select("doc_id", n.cast("long").alias("n_chars"), "_edited", "_fingerprint", "_next_fingerprint")
    )
    return with_fingerprint(followed, "_edited", "_edited_fingerprint").select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_fingerprint")).alias("fingerprint"), as_text(F.col("_edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("_fingerprint"), F.col("_edited_fingerprint")).alias("near_edited"),
        likeness(F.col("_fingerprint"), F.col("_next_fingerprint")).alias("near_next"),
    )
