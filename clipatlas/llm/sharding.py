"""Shards by jump consistent hashing, with a gapless place in each shard.

The shard of a row follows from its key and the number of shards alone, without a ring table. One
more shard takes rows only into itself. Everything is a column expression or a DataFrame operation.

Defined cases: a null key counts as key 0, a null text has zero bytes and the checksum of the empty
text. Rows equal in key, size and checksum are interchangeable; they get neighbouring slots. An empty
table gives an empty table. Further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: the multiplier of its generator, in two halves of 32 bits.
_MULTIPLIER = 2862933555777941757
_HIGH, _LOW = _MULTIPLIER >> 32, _MULTIPLIER & 0xFFFFFFFF

#: So many jumps are tried before the full number, which is the number of shards. The mean is ln(shards).
_FIRST_JUMPS = 64


def _times_low(half: Column, factor: int) -> Column:
    """The low 32 bits of a product of two 32-bit numbers, without overflow."""
    upper = F.shiftleft((F.shiftright(half, 16) * factor).bitwiseAND(0xFFFF), 16)
    return (half.bitwiseAND(0xFFFF) * factor + upper).bitwiseAND(0xFFFFFFFF)


def _jump(state: Column, shards: int) -> Column:
    """One draw of the generator and the jump it leads to, unless the last jump left the range."""
    high, low = state["high"], state["low"]
    first = low.bitwiseAND(0xFFFF) * _LOW + 1
    second = F.shiftright(low, 16) * _LOW + F.shiftright(first, 16)
    new_low = F.shiftleft(second.bitwiseAND(0xFFFF), 16).bitwiseOR(first.bitwiseAND(0xFFFF))
    carried = F.shiftright(second, 16)
    new_high = (_times_low(high, _LOW) + _times_low(low, _HIGH) + carried).bitwiseAND(0xFFFFFFFF)
    return F.when(state["next"] >= shards, state).otherwise(
        F.struct(
            state["next"].alias("shard"),
            F.lit(0).cast("long").alias("next"),
            new_high.alias("high"),
            new_low.alias("low"),
        )
    )


def _landing(state: Column) -> Column:
    draw = (F.shiftright(state["high"], 1) + 1).cast("double")
    return ((state["shard"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw)).cast("long")


def _walk(key: Column, shards: int, jumps: int) -> Column:
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("next"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(0xFFFFFFFF).alias("low"),
    )

    def step(state: Column, _: Column) -> Column:
        # two nested transforms keep the drawn number in one place instead of repeating its expression
        drawn = F.transform(F.array(_jump(state, shards)), lambda s: F.struct(
            s["shard"].alias("shard"), F.when(state["next"] >= shards, s["next"]).otherwise(_landing(s)).alias("next"),
            s["high"].alias("high"), s["low"].alias("low"),
        ))
        return F.element_at(drawn, 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, step)


def jump_state(key: Column, shards: int) -> Column:
    """``shard``: the shard of an integer key; ``next``: where its next jump lands, at least ``shards``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    quick = _walk(key, shards, min(shards, _FIRST_JUMPS))
    if shards <= _FIRST_JUMPS:
        return quick
    ended = F.transform(F.array(quick), lambda s: F.when(s["next"] >= shards, s).otherwise(_walk(key, shards, shards)))
    return F.element_at(ended, 1)


def stable_key(*columns: str) -> Column:
    """An integer key for rows that have none: a hash of the columns named."""
    return F.xxhash64(*columns)


def shard_documents(docs: DataFrame, shards: int = 16, slices: int = 256) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row for each row of ``docs``.

    ``slot`` numbers the rows of a shard from 0, in the order of slices by hash, then doc_id, size and
    checksum. Each shard is numbered in ``slices`` parts, so no task holds a whole shard; the offsets of
    the parts are shards x slices small rows. Repeated rows are counted before they are shuffled, so a
    key that holds a third of all rows is one row here. More rows ask for more slices.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = (
        equal.withColumn("state", jump_state(F.col("doc_id"), shards))
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(slices)))
        .select("doc_id", "size", "text_crc32", "copies", "slice", F.col("state.shard").alias("shard"), F.col("state.next").alias("next"))
    )
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("shard", "slice").agg(F.sum("copies").alias("rows"))
        .select("shard", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    )
    earlier = Window.partitionBy("shard", "slice").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("first", F.coalesce(F.sum("copies").over(earlier), F.lit(0)))
    start = F.col("offset") + F.col("first")
    return (
        numbered.join(F.broadcast(offsets), ["shard", "slice"])  # shards x slices rows, both parameters
        .withColumn("slot", F.explode(F.sequence(start, start + F.col("copies") - 1)))
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
            F.col("slot").cast("long").alias("slot"),
            F.when(F.col("next") == shards, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("grown_shard"),
        )
    )
