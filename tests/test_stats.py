import pytest
from pyspark.sql import functions as F

from clipatlas.operators import stats
from clipatlas.operators.catalog import asset_detail, first_scene, list_assets, scene_notes, with_display_defaults
from clipatlas.plans.relations import relation
from clipatlas.schemas import PROMPTS, SCENE_TEXT_COLUMNS, SCENES
from clipatlas.sources.commits import Snapshot

LOOSE = ", ".join(f"{c} string" for c in SCENE_TEXT_COLUMNS)


def make(spark, *rows):
    filled = [tuple(r.get(c) for c in SCENE_TEXT_COLUMNS) for r in rows]
    return spark.createDataFrame(filled, LOOSE)


def test_nothing_gives_zeros(spark):
    nothing = spark.createDataFrame([], SCENES)
    document = stats.stats_document(stats.stats(nothing, Snapshot(spark, "/no/such/library").read("prompts", PROMPTS, []))).first()
    assert document.asDict() == {
        "total_assets": 0, "total_scenes": 0, "average_scenes_per_asset": 0.0,
        "source_breakdown": {}, "total_duration_seconds": 0, "avg_scene_duration_seconds": 0, "top_tags": {},
        "total_prompt_videos": 0,
    }
    assert stats.stats(nothing).count() == 6


def test_document(spark):
    df = make(
        spark,
        {"video_id": "a", "source": "gs://x", "timestamp_start": "00:00", "timestamp_end": "00:10", "category": "c", "tags": "x, y"},
        {"video_id": "a", "source": "gcs", "timestamp_start": "00:10", "timestamp_end": "00:05", "category": "", "tags": "x,,"},
        {"video_id": "b", "source": None, "timestamp_start": "bad", "timestamp_end": "00:05", "category": None, "tags": " "},
        {"video_id": "b", "source": "Local", "timestamp_start": "", "timestamp_end": "", "category": " c", "tags": None},
        {"video_id": "b", "source": "YOUTUBE", "timestamp_start": None, "timestamp_end": None, "category": "c", "tags": "y"},
    )
    assert stats.stats_document(stats.stats(df)).first().asDict() == {
        "total_assets": 2, "total_scenes": 5, "average_scenes_per_asset": 2.5,
        "source_breakdown": {"GCS": 2, "Local": 2, "YouTube": 1},
        "total_duration_seconds": 15, "avg_scene_duration_seconds": 3, "top_tags": {"x": 2, "y": 2},
        "total_prompt_videos": 0,
    }
    many = make(spark, *[{"video_id": "a", "category": f"c{i}"} for i in range(300)])
    assert stats.stats(many).filter("metric = 'category_breakdown'").count() == 300
    assert stats.stats_document(stats.stats(many)).first().total_scenes == 300


def test_long_form_agrees_with_its_parts(spark, sf):
    scenes, prompts = relation(spark, sf, "scenes").cache(), relation(spark, sf, "prompts")
    long = {(r.metric, r.key): r.value for r in stats.stats(scenes, prompts).collect()}
    for part in (stats.scene_totals(scenes), stats.total_prompt_videos(prompts), stats.total_assets(scenes), stats.total_scenes(scenes)):
        for name, value in part.first().asDict().items():
            assert long[(name, "")] == value
    for part, metric in ((stats.category_breakdown(scenes), "category_breakdown"),
                         (stats.source_breakdown(scenes), "source_breakdown"), (stats.top_tags(scenes), "top_tags")):
        assert {k: v for (m, k), v in long.items() if m == metric} == {r[0]: r[1] for r in part.collect()}


def test_half_is_rounded_to_even(spark):
    rows = [{"video_id": f"v{i % 4}", "timestamp_start": "0", "timestamp_end": str(i % 2)} for i in range(9)]
    totals = stats.scene_totals(make(spark, *rows)).first()
    assert totals.average_scenes_per_asset == 2.2
    rows = [{"video_id": "v", "timestamp_start": "0", "timestamp_end": e} for e in ("1", "4")]
    assert stats.scene_totals(make(spark, *rows)).first().avg_scene_duration_seconds == 2


def test_breakdown_percent(spark):
    df = spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "category string, n long")
    assert {r.category: r.percent for r in stats.breakdown_percent(df).collect()} == {"a": 100.0, "b": 50.0, "c": 25.0}
    assert stats.breakdown_percent(df.limit(0)).count() == 0


def test_list_assets(spark):
    tags = {"null": [None], "empty": [""], "two empty": ["", ""], "empty and null": [None, ""], "sets": ["a,b", "a"],
            "blanks": ["a", " a"], "comma": [","], "repeated": ["a"] * 50}
    rows = [{"video_id": v, "summary": "s", "tags": t} for v, ts in tags.items() for t in ts]
    rows += [{"video_id": "sets", "summary": "other", "tags": "z"}, {"video_id": "sets", "summary": None, "tags": "n"}]
    got = {(r.video_id, r.summary): r.tags for r in list_assets(make(spark, *rows)).collect()}
    assert got == {
        ("null", "s"): [], ("empty", "s"): [], ("two empty", "s"): [""], ("empty and null", "s"): [],
        ("sets", "s"): ["a", "b"], ("blanks", "s"): [" a", "a"], ("comma", "s"): [""], ("repeated", "s"): ["a"],
        ("sets", "other"): ["z"], ("sets", None): ["n"],
    }


def test_asset_detail_and_first_scene(spark):
    starts = ["1:00:00", "00:05", "00:05", "", "59:59"]
    rows = [{"video_id": "v", "title": f"t{i}", "timestamp_start": s, "timestamp_end": "00:09", "tags": "a,b", "source": "gs://b/v"}
            for i, s in enumerate(starts)] + [{"video_id": "w", "title": "other"}]
    detail = asset_detail(make(spark, *rows), "v").collect()
    assert [r.title for r in detail] == ["t3", "t1", "t2", "t4", "t0"]
    assert detail[0].tags == ["a", "b"] and detail[0].video_url.endswith("/b/v")
    assert {r.video_id: r.title for r in first_scene(make(spark, *rows)).collect()} == {"v": "t3", "w": "other"}
    assert asset_detail(make(spark, *rows), "none").count() == 0


def test_notes_and_defaults(spark):
    df = make(spark, {"title": "", "summary": None, "audio_cues": "drum", "pacing": "", "edit_cut_notes": " "})
    assert {(r.label, r.note) for r in scene_notes(df).collect()} == {("Audio", "drum"), ("Notes", " ")}
    shown = with_display_defaults(df).first()
    assert (shown.title, shown.summary) == ("Untitled Scene", "No summary available")


def test_hot_tag_text_is_counted_before_it_is_split(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "a,b").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("tags"))
    assert {r.tag: r.n for r in stats.tag_frequency(df).collect()}["a"] == 6667
    plan = stats.tag_frequency(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")


def test_figures_of_batches_add_up(spark, sf, scenes_of_batches):
    """Partial figures of batches, one of them repeated and replaced, against a full scan."""
    batches, prompts = scenes_of_batches
    partials = None
    for batch in batches:
        part = stats.partial_figures(batch)
        assert part.schema.fieldNames() == stats.FIGURES.fieldNames()
        partials = part if partials is None else partials.unionByName(part)
    everything = batches[0].unionByName(batches[1]).unionByName(batches[2])
    got, want = (sorted(map(repr, df.collect())) for df in (stats.stats_of(partials, prompts), stats.stats(everything, prompts)))
    assert got == want
    none = partials.limit(0)
    assert sorted(map(repr, stats.stats_of(none).collect())) == sorted(map(repr, stats.stats(batches[0].limit(0)).collect()))


@pytest.fixture
def scenes_of_batches(spark, sf):
    scenes = relation(spark, sf, "scenes")
    number = F.col("title").substr(7, 12).cast("int") % 5
    return [scenes.filter(number == 0), scenes.filter(number == 1), scenes.filter(number >= 1)], relation(spark, sf, "prompts")
