"""What the search for repeated passages stores and shuffles of a text, and how it tells words apart."""

import numpy as np
import pyarrow as pa

from clipatlas.llm import passages
from tests.llm.test_passages import brute
from tests.llm.test_whole_passages import LONG, cut


def batch(*texts):
    return iter([pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": list(texts)})])


def test_rows_are_short():
    hashed = pa.Table.from_batches(passages._hashes(batch(LONG, f"x {LONG}"), 25, True))
    assert all(0 <= x < 1 << 40 for c in hashed.columns for x in c.to_pylist())
    every = np.full((2, passages._MAP_BITS // 64), ~np.uint64(0))
    rows = pa.Table.from_batches(passages._rows(batch(LONG, f"x {LONG}"), every, 25, True))
    # 96 bits of a digest, and no word numbers where they follow from the place.
    assert rows.schema.field("d1").type == pa.int32()
    assert rows.column("word").null_count == rows.column("after").null_count == rows.num_rows > 0


def test_units_with_odd_blanks_and_letters(spark, tmp_path):
    long = "q" * 500
    passage = f"Straße ΑΣ\xa0İx {long} " + " ".join(f"wort{i}" for i in range(25))
    rows = [(1, f"  {passage}. Own"), (2, f" \n{passage.upper().lower()}.\x85End\r\n"), (3, f"a　{passage}!  "), (4, f"{long}r " * 30), (5, f"{long}s " * 30), (6, "\t \n"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in passages.repeated_spans(spark, docs, str(tmp_path / "units")).select("doc_id", "start", "stop", "words", "first_doc_id").collect()}
    assert found == set(brute([r for r in rows if r[1]], 25))
    _, texts = cut(spark, rows, tmp_path / "whole")
    assert texts[4][:502] == f"{long}r " and texts[5][:502] == f"{long}s " and texts[6] == "\t \n"


def test_packed_rows_are_short_and_lose_nothing(spark):
    top = (1 << 31) - 1
    rows = [
        (7, (1 << 32) - 1, True, 0, 0, 0, 1, None, None, -(1 << 63), -1, False), (-7, 0, False, 70_000, 70_003, 2_000_000, 2_000_900, 3, 9, 5, 6, True),
        (1, 2, True, top, top, top, top, top, top, 0, 0, True), (1, 2, False, 0, top, 0, top, 0, 0, 0, 0, False),
    ]
    packed = passages._packed(spark.createDataFrame(rows, passages._ROWS))
    assert len(packed.columns) == 7
    again = {r.low >> 1 & 1 for r in packed.where("doc_id = -7").collect()}
    found = passages._unpacked(packed, "d0", "d1").collect()
    assert again == {1} and {tuple(r) for r in found} == {r[:-1] for r in rows}
