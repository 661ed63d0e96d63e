"""The registered queries and the pipeline over a whole small table."""

import hashlib
import os
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as contract
import corpus_pipeline
from clipatlas.llm.queries import CHECKS, QUERIES
from tests.llm.test_near_duplicates import brute as near_brute
from tests.llm.test_decontamination import brute as contained_brute
from clipatlas.llm import passages
from tests.llm.test_passages import brute as passages_brute
from tests.llm.test_whole_passages import windows

COLUMNS = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op2": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op5": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op8": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op13": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    for column, kind in COLUMNS.get(name.split("_")[0], {}).items():
        assert dict(df.dtypes)[column] == kind
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    assert rows
    if name.split("_")[0] not in ("op6", "op7", "op11", "op12", "op13"):
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    if name in CHECKS:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "embeddings", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        result = con.execute(CHECKS[name])
        columns = [d[0] for d in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in rows)


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = [spark.read.parquet(f"{sf}/documents.parquet")]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs[-1], sf).write.parquet(f"{folder}/{number}")
        docs.append(spark.read.parquet(f"{folder}/{number}"))
    return docs


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1]) and len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, sf, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = dict(texts(stages[0])), dict(texts(stages[1]))
    assert after.items() <= before.items() and len(after) < len(before)
    good = [d for d in before if labels.get(d) == 1]
    assert sum(d in after for d in good) >= 0.95 * len(good)


def test_near_duplicate_stage(stages):
    before, after = texts(stages[1]), texts(stages[2])
    kept = {d for d, _, component in near_brute(before) if d == component}
    assert sorted(after) == sorted(r for r in before if r[0] in kept)


def test_passage_stage(stages):
    """What goes is what runs of units and windows of 25 words cover, and the white space after it."""
    before, after = texts(stages[2]), dict(texts(stages[3]))
    cut = windows(before, 25, passages._TOKEN)
    for d, start, stop, _, _ in passages_brute(before, 25):
        cut.setdefault(d, set()).update(range(start, stop))
    assert set(after) == {d for d, _ in before} and cut
    for d, text in before:
        if d not in cut:
            assert after[d] == text
        else:
            assert "".join(after[d].split()) == "".join("".join(c for i, c in enumerate(text) if i not in cut[d]).split())


def test_decontamination_stage(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = texts(stages[3])
    leaks = {d for d, _, _, _ in contained_brute(before, items)}
    assert sorted(texts(stages[4])) == sorted(r for r in before if r[0] not in leaks)


def test_encoding_stage(stages):
    before = dict(texts(stages[4]))
    rows = stages[5].collect()
    assert len(rows) == len(before)
    for r in rows:
        assert r["decoded_sha256"] == hashlib.sha256(before[r["doc_id"]].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["n_tokens"] == len(np.frombuffer(r["ids"], "<u4"))


def test_stages_on_edges(spark, sf, tmp_path):
    schema = stages_schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 50_000, "en", "s", 250_000), (4, "same text of a few words", None, "s", 24), (4, "same text of a few words", None, "s", 24), (None, "no id here", "de", None, 10)]
    for name, docs in (("rows", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], stages_schema))):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            if number < 4:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_stages_pass_clashing_columns_through(spark, sf):
    text = "A line that is long enough to be a passage of its own, with more than twenty five words in it, so that it goes wherever it is there again."
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id string, _version int, _spans string, _key string, quality_score double"
    rows = [(1, text, "en", "s", len(text), "i", 7, "s", "k-a", 5.0), (2, "Own start. " + text, "en", "s", 0, "j", 8, "t", "k-b", 6.0)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        for r in out.collect():
            assert tuple(r)[5:] == rows[r["doc_id"] - 1][5:]


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
