"""Conversations checked for faults and repaired at the least cost, so that roles follow the grammar ``(s?(ua)+)?``.

Rows of a conversation are taken by turn (nulls first), then by role and the SHA-256 of the text, so that the order is
total up to equal rows. A row's first fault counts: blank, duplicate of an earlier role and text, truncated (the last
character that is not white space ends no sentence). Blank and duplicate rows go; see ``role_grammar`` for the rest.

Rows are sorted by ranges over all conversations and numbered, so a conversation of any size is spread over tasks. Of
each run of rows a task hands on the ways through it (from each stack to each stack) and not the rows; the runs of a
conversation are then joined in their order. The first occurrence of a role and text is found by a grouping of
digests and joined by row number, so many equal rows are no hot key. The repaired rows stream through one task for each
conversation in the end, a batch at a time, since their digest is defined by one sequence; what is held of a
conversation is its audit, which is one value of the result as well.

Defined cases: a null role or text is one space; rows without ``conv_id`` are one conversation; a role that is empty or begins
with another letter than s, u, a has to be given another or go. Rows with equal turns are ordered as said. A conversation
without rows, or without any that can stay, has an empty repair. Very long texts are sent twice through a shuffle and not
held together. Further columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipatlas.llm import role_grammar as grammar

#: Rows of a run at most.
RUN_ROWS = 512
_WHITE = " \t\n\x0b\x0c\r"
_BATCH = 10_000
_COUNTS = ["blank", "duplicate", "truncated"]
#: Initials that may follow each other.
_LEGAL = ("su", "ua", "au")
_WAYS = "ways array<struct<before:int,after:int,cost:long,audit:string>>"
_WAY_TYPE = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def number_rows(conversations: DataFrame, folder: str) -> DataFrame:
    """conv_id, pos, role, text, digest: all rows in order, stored. ``pos`` counts up over all conversations, with gaps."""
    space = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    order = ["conv_id", "turn", "role", "digest"]
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    # The task of origin splits a range of equal rows.
    dealt = rows.withColumn("origin", F.spark_partition_id()).repartitionByRange(*order, "origin").sortWithinPartitions(*order)
    numbered = dealt.select("conv_id", F.monotonically_increasing_id().alias("pos"), "role", "text", "digest")
    numbered.write.parquet(f"{folder}/rows")
    return conversations.sparkSession.read.schema(numbered.schema).parquet(f"{folder}/rows")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, pos, initial and the first fault, if any, of the rows of ``number_rows``."""
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    last = F.right(F.rtrim("text", F.lit(_WHITE)), F.lit(1))
    facts = rows.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), last.alias("last"))
    # Neither white space nor the end of a sentence at the end; without any other character there is no last one.
    fault = (
        F.when(F.col("last") == "", "blank")
        .when(F.col("first").isNull(), "duplicate")
        .when(~F.col("last").isin(".", "!", "?"), "truncated")
    )
    return facts.join(first, "pos", "left").select("conv_id", "pos", "initial", fault.alias("fault"))


def _runs(batches: Iterator[pa.RecordBatch], run_rows: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one conversation that come one after the other in a task."""
    out, run, first_of_task = [], None, True

    def close() -> None:
        nonlocal first_of_task
        if run is not None:
            # The first run of a task may go on with a conversation of the task before, as does a run that was full.
            ways = grammar.passages("".join(run["codes"]), first_of_task or run["goes_on"])
            out.append({**run, "ways": [dict(zip(("before", "after", "cost", "audit"), w, strict=True)) for w in ways]})
            first_of_task = False

    def batch_of() -> pa.RecordBatch:
        columns = {c: [r[c] for r in out] for c in ("conv_id", "pos", *_COUNTS, "illegal", "initial", "final", "ways")}
        counts = [pa.array(columns[c], pa.int64()) for c in (*_COUNTS, "illegal")]
        texts = [pa.array(columns[c], pa.string()) for c in ("initial", "final")]
        ids = pa.array(columns["conv_id"], id_type)
        return pa.RecordBatch.from_arrays([ids, pa.array(columns["pos"], pa.int64()), *counts, *texts, pa.array(columns["ways"], _WAY_TYPE)], list(columns))

    id_type = pa.null()
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for conv_id, pos, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "initial", "fault")), strict=True):
            same = run is not None and run["conv_id"] == conv_id
            if not same or len(run["codes"]) == run_rows:
                close()
                run = {"conv_id": conv_id, "pos": pos, "codes": [], "illegal": 0, "initial": initial, "goes_on": same, **dict.fromkeys(_COUNTS, 0)}
                if len(out) >= _BATCH:
                    yield batch_of()
                    out = []
            elif run["final"] + initial not in _LEGAL:
                run["illegal"] += 1
            code = initial if initial and initial in grammar.KNOWN else "o"
            if fault is not None:
                run[fault] += 1
                code = code.upper() if fault == "truncated" else grammar.GONE
            run["codes"].append(code)
            run["final"] = initial
    close()
    if out:
        yield batch_of()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its runs in their order."""
    names = ["conv_id", *_COUNTS, "illegal", "cost", "audit"]
    out, one = [], None

    def close() -> None:
        if one is not None:
            cost, audit = grammar.finished(one["tops"])
            out.append((one["conv_id"], *(one[c] for c in _COUNTS), one["illegal"], cost, audit))

    def batch_of() -> pa.RecordBatch:
        kinds = [id_type, *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    id_type = pa.null()
    for batch in batches:
        id_type = batch.schema.field("conv_id").type
        for run in batch.to_pylist():
            if one is None or one["conv_id"] != run["conv_id"]:
                close()
                one = {"conv_id": run["conv_id"], "tops": {grammar.ROOT: (0, "")}, "final": None, "illegal": 0, **dict.fromkeys(_COUNTS, 0)}
                if len(out) >= _BATCH:
                    yield batch_of()
                    out.clear()
            one["tops"] = grammar.joined(one["tops"], [(w["before"], w["after"], w["cost"], w["audit"]) for w in run["ways"]])
            for c in (*_COUNTS, "illegal"):
                one[c] += run[c]
            if one["final"] is not None and one["final"] + run["initial"] not in _LEGAL:
                one["illegal"] += 1
            one["final"] = run["final"]
    close()
    if out:
        yield batch_of()


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")


def find_repairs(rows: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """conv_id, blank, duplicate, truncated, illegal, cost, audit of all conversations in the rows of ``number_rows``."""
    id_type = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in (*_COUNTS, "illegal"))
    sorted_rows = faults(rows).repartitionByRange("pos").sortWithinPartitions("pos")
    runs = sorted_rows.mapInArrow(lambda batches: _runs(batches, run_rows), f"conv_id {id_type}, pos long, {counts}, initial string, final string, {_WAYS}")
    return _in_order(runs).mapInArrow(_joined, f"conv_id {id_type}, {counts}, cost long, audit string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of what stays or comes in; (conv_id, None, None, None) where a conversation begins."""
    audit, body, at, before = "", 0, 0, ""
    for batch in batches:
        for conv_id, pos, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "role", "text")), strict=True):
            if pos < 0:  # the audit comes first
                audit, body, at, before = text, len(text.rstrip("I")), 0, ""
                yield conv_id, None, None, None
                continue
            upto = at
            while audit[upto] == "I":
                upto += 1
            # What is inserted before this row, its own edit, and after the last row what is inserted at the end.
            upto = len(audit) if upto + 1 == body else upto + 1
            for edit in audit[at:upto]:
                if edit != "D":
                    shown = role if edit == "K" else grammar.rerolled(before)
                    before = shown[:1]
                    yield conv_id, edit, shown, "" if edit == "I" else text
            at = upto


def _with_audits(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    heads = repairs.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return _in_order(rows.select("conv_id", "pos", "role", "text").unionByName(heads))


def repaired_rows(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit: the repaired conversations, ``place`` counting from 1."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_kind
            for batch in batches:
                id_kind = batch.schema.field("conv_id").type
                yield batch

        def batch_of(out: list) -> pa.RecordBatch:
            kinds = [id_kind, pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "role", "text", "edit"])

        out, place = [], 0
        for conv_id, edit, role, text in _edited(seen()):
            if edit is None:
                place = 0
                continue
            place += 1
            out.append((conv_id, place, role, text, edit))
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return _with_audits(rows, repairs).mapInArrow(task, f"conv_id {id_type}, place long, role string, text string, edit string")


def repaired_digests(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired ``role:text``, joined by line feeds."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal id_kind
            for batch in batches:
                id_kind = batch.schema.field("conv_id").type
                yield batch

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (id_kind, pa.string()), strict=True)], ["conv_id", "repaired_sha256"])

        out, digest, whose, some = [], None, None, False
        for conv_id, edit, role, text in _edited(seen()):
            if edit is None:
                if digest is not None:
                    out.append((whose, digest.hexdigest()))
                digest, whose, some = hashlib.sha256(), conv_id, False
                if len(out) >= _BATCH:
                    yield batch_of(out)
                    out = []
                continue
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            some = True
        if digest is not None:
            out.append((whose, digest.hexdigest()))
        if out:
            yield batch_of(out)

    return _with_audits(rows, repairs).mapInArrow(task, f"conv_id {id_type}, repaired_sha256 string")


def turn_gaps(conversations: DataFrame) -> DataFrame:
    """conv_id and how many turns are missing between its first and its last; 0 without any turn."""
    turns = conversations.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))


def repair_conversations(spark: SparkSession, conversations: DataFrame, folder: str, known: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of all conversations.

    ``known`` names conversations (conv_id) that count although they may have no rows.
    """
    rows = number_rows(conversations, folder)
    find_repairs(rows).write.parquet(f"{folder}/repairs")
    repairs = spark.read.parquet(f"{folder}/repairs")
    parts = [repairs, repaired_digests(rows, repairs), turn_gaps(conversations)]
    return merged(parts if known is None else [*parts, known.select("conv_id").distinct()])


#: The columns of a result, and what a conversation has that none of the parts knows.
RESULT = {"gaps": 0, **dict.fromkeys(_COUNTS, 0), "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}


def merged(parts: list[DataFrame]) -> DataFrame:
    """One row for each conv_id, null included, from tables that each know some columns of it."""
    whole = None
    for part in parts:
        kinds = {c: "string" if isinstance(v, str) else "long" for c, v in RESULT.items()}
        shown = part.select("conv_id", *[F.col(c) if c in part.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
        whole = shown if whole is None else whole.unionByName(shown)
    return whole.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(v).cast("string" if isinstance(v, str) else "long")).alias(c) for c, v in RESULT.items()])
