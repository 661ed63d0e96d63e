"""Every registered query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as contract
from clipatlas.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN"}
QUERIES, CHECKS = registry.QUERIES, registry.CHECKS


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert got
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name in CHECKS:
        result = duck.execute(CHECKS[name])
        columns = {d[0]: str(d[1]) for d in result.description}
        assert {c: TYPES[t] for c, t in df.dtypes} == columns
        order = [list(columns).index(n) for n in names]
        want = [tuple(r[i] for i in order) for r in result.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_checks_belong_to_queries():
    assert set(CHECKS) == set(QUERIES)
    assert QUERIES.items() <= contract.queries().items() and set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 5


SCALAR = [
    "timestamp_seconds", "timestamp_seconds_lenient", "scene_duration", "source_class", "scene_video_url", "youtube_embed_url",
    "playback_url", "tags_split", "tags_clean", "short_asset_id", "format_duration", "plan_requests", "decode_queries",
    "parse_responses", "cosine_similarity", "embed_text", "stats", "list_assets",
    "best_match_per_id",
]


@pytest.mark.parametrize("name", SCALAR)
def test_expressions_stay_in_the_jvm(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    for word in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas"):
        assert word not in plan


@pytest.mark.parametrize("name", ["scene_search", "prompt_search", "prompt_search_single_pass", "top_tags"])
def test_limits_are_top_k(spark, sf, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, sf))


def test_ranks_are_limited_before_the_shuffle(spark, sf):
    assert plan_of(QUERIES["knn_join"](spark, sf)).count("WindowGroupLimit") >= 2
