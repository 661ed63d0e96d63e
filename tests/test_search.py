import math

import pytest
from pyspark.sql import functions as F

from clipatlas.operators import ivf
from clipatlas.operators.knn import knn_join
from clipatlas.operators.search import (
    best_match_per_id,
    prompt_matches,
    prompt_search,
    prompt_search_single_pass,
    scene_search,
    scene_search_batch,
    scene_search_stored,
    search_candidates,
)
from clipatlas.plans.relations import relation, table
from clipatlas.schemas import SCENES
from clipatlas.sources.tables import ROW_PLACE, append_scenes
from clipatlas.workdir import work_folder


@pytest.fixture(scope="module")
def scenes(spark, sf):
    return relation(spark, sf, "scenes").cache()


@pytest.fixture(scope="module")
def prompts(spark, sf):
    return relation(spark, sf, "prompts").cache()


def vector(spark, sf, vec_id):
    return [float(x) for x in table(spark, sf, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding]


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scene_search_order_and_ties(spark):
    def scene(video, title, embedding):
        return (video, "gcs", "00:01", "00:02", title, *["x"] * 8, "s", "a,b", embedding)

    data = [
        scene("b", "2", [2.0, 0.0]), scene("a", "3", [1.0, 0.0]), scene("a", "1", [5.0, 0.0]), scene("c", "4", [0.0, 1.0]),
        scene("d", "5", [0.0, 0.0]), scene("e", "6", []), scene("f", "7", None), scene("g", "8", [1.0]),
        scene("h", "9", [-1.0, 0.0]),
    ]
    nullable = "video_id string, source string, timestamp_start string, timestamp_end string, title string, " + \
        ", ".join(f"{f.name} string" for f in SCENES.fields[5:15]) + ", embedding array<double>"
    df = spark.createDataFrame(data, nullable)
    got = scene_search(df, [1.0, 0.0], k=10, bucket="bk").collect()
    assert [r.title for r in got] == ["1", "3", "2", "4", "5", "9"]
    assert [round(r.similarity, 9) for r in got] == [1, 1, 1, 0, 0, -1]
    assert got[0].tags == ["a", "b"] and got[0].video_url.endswith("/bk/a")
    assert scene_search(df, [1.0, 0.0]).count() == 5
    near = scene_search(df, [1.0, 0.0], k=2, metric="euclidean").collect()
    assert [(r.title, r.distance) for r in near] == [("3", 0.0), ("5", 1.0)] or near[0].title == "3"


def test_stored_search_is_the_same(spark, sf, scenes):
    path = work_folder(spark, "t")
    append_scenes(scenes.repartition(6), path, required=())
    append_scenes(scenes.limit(0), path, by_video=True)
    q = vector(spark, sf, 11)
    assert rows(scene_search_stored(spark, path, q, k=7)) == rows(scene_search(scenes, q, k=7))


def test_batch_is_the_single_search_repeated(spark, sf, scenes):
    ids = [3, 44, 210]
    vectors = table(spark, sf, "embeddings").filter(F.col("vec_id").isin(ids)).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_embedding")
    )
    batch = scene_search_batch(scenes, vectors, k=6, key=["title"]).orderBy("query_id", "rank").collect()
    for i in ids:
        want = [(r.title, round(r.distance, 9)) for r in scene_search(scenes, vector(spark, sf, i), k=6).collect()]
        assert [(r.title, round(r.distance, 9)) for r in batch if r.query_id == i] == want


@pytest.mark.parametrize("vec_id", [0, 7, 123, 499])
def test_prompt_search_in_one_pass(spark, sf, prompts, vec_id):
    q = vector(spark, sf, vec_id)
    two = prompt_search(prompts, q).collect()
    one = prompt_search_single_pass(prompts, q).collect()
    assert one == two
    assert search_candidates(prompts, q).count() == 6


def test_prompts_without_a_vector(spark):
    schema = "id string, gcs_video_path string, prompt_text string, video_embedding array<double>, " \
        "prompt_embedding array<double>, created_at timestamp"
    data = [("a", "p", "t", [], [1.0, 0.0], None), ("b", "gs://x/y", "t", [0.0, 1.0], [], None),
            ("c", "p", "t", [], [], None), ("d", "p", "t", None, [1.0, 1.0], None)]
    df = spark.createDataFrame(data, schema)
    got = prompt_search(df, [1.0, 0.0]).collect()
    assert [(r.id, round(r.best_distance, 6)) for r in got] == [("a", 0.0), ("d", round(1 - 1 / math.sqrt(2), 6)), ("b", 1.0)]
    assert [r.id for r in prompt_search_single_pass(df, [1.0, 0.0]).collect()] == ["a", "d", "b"]
    assert got[2].video_url == "https://storage.mtls.cloud.google.com/x/y" and got[0].video_url == ""
    assert best_match_per_id(prompt_matches(df, [1.0, 0.0])).count() == 3


@pytest.fixture(scope="module")
def cells(spark, scenes):
    """A clustered table of the scenes, with copies of one vector for a third of it, zeros and gaps."""
    zero = F.array_repeat(F.lit(0.0), 64)
    number = F.col("title").substr(7, 12).cast("int")
    odd = scenes.withColumn(
        "embedding",
        F.when(number % 50 == 1, zero).when(number % 50 == 2, F.array().cast("array<double>"))
        .when(number % 3 == 0, F.array_repeat(F.lit(0.5), 64)).otherwise(F.col("embedding")),
    ).cache()
    path = work_folder(spark, "t")
    ivf.ivf_build(odd.repartition(4), path, nlist=12)
    return odd, path


def test_cells_hold_every_usable_row_once(spark, cells):
    odd, path = cells
    stored = ivf.ivf_rows(spark, path)
    usable = odd.filter(F.size("embedding") > 0)
    assert stored.count() == usable.count() == stored.select("title").distinct().count()
    zeros = stored.filter(F.col("norm") == 0)
    assert [r.cell for r in zeros.select("cell").distinct().collect()] == [ivf.NO_CELL]
    sizes = ivf.ivf_cells(spark, path).collect()
    assert abs(sum(r.share for r in sizes) - 1) < 1e-9


def test_large_cell_is_spread_over_tasks(spark, cells):
    odd, _ = cells
    path = work_folder(spark, "t")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "20000")
    try:
        ivf.ivf_build(odd.repartition(6), path, nlist=4)
    finally:
        spark.conf.unset(size)
    largest = max(ivf.ivf_cells(spark, path).collect(), key=lambda r: r.n_rows).cell
    rows = ivf.ivf_rows(spark, path).filter(F.col("cell") == largest)
    assert rows.select(F.input_file_name().alias("f")).distinct().count() > 1


def test_probing_all_cells_is_exact(spark, sf, cells):
    odd, path = cells
    for q in (vector(spark, sf, 5), [0.5] * 64, [0.0] * 64):
        exact = scene_search(odd, q, k=8)
        assert rows(ivf.ivf_search(spark, path, q, k=8, nprobe=12)) == rows(exact)
    vectors = relation(spark, sf, "query_vectors")
    narrow = odd.select("video_id", "timestamp_start", "title", "embedding")
    exact = knn_join(narrow, vectors, 5)
    full = ivf.ivf_search_batch(spark, path, vectors, nprobe=12)
    recall = ivf.ivf_recall(exact, full, ["title"]).agg(F.min("recall"), F.count("*")).first()
    assert tuple(recall) == (1.0, 500)
    some = ivf.ivf_recall(exact, ivf.ivf_search_batch(spark, path, vectors, nprobe=3), ["title"])
    assert 0.5 < some.agg(F.avg("recall")).first()[0] <= 1.0


def test_batch_and_single_probe_the_same_cells(spark, sf, cells):
    _, path = cells
    vectors = relation(spark, sf, "query_vectors").filter("query_id IN (9, 10)")
    batch = ivf.ivf_search_batch(spark, path, vectors, nprobe=2).orderBy("query_id", "rank").collect()
    for i in (9, 10):
        single = ivf.ivf_search(spark, path, vector(spark, sf, i), nprobe=2).collect()
        assert [r.title for r in batch if r.query_id == i] == [r.title for r in single]


def test_batch_reads_only_probed_folders(spark, sf, cells):
    _, path = cells
    vectors = relation(spark, sf, "query_vectors").filter("query_id = 9")
    found = ivf.ivf_search_batch(spark, path, vectors, nprobe=2)
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [coarse" in plan and "In(cell" in plan


def test_only_probed_folders_are_read(spark, sf, cells):
    _, path = cells
    found = ivf.ivf_candidates(spark, path, vector(spark, sf, 5), nprobe=2)
    read = {r.cell for r in found.select("cell").distinct().collect()}
    assert len(read - {ivf.NO_CELL}) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [coarse" in plan and "In(cell" in plan


def test_append_to_cells(spark, sf, scenes):
    path = work_folder(spark, "t")
    early = F.col("title") < "scene 000000000600"
    ivf.ivf_build(scenes.filter(early), path, nlist=8)
    ivf.ivf_append(scenes.filter(~early), path)
    q = vector(spark, sf, 77)
    assert rows(ivf.ivf_search(spark, path, q, nprobe=8)) == rows(scene_search(scenes, q))


def test_cells_of_a_table_without_directions(spark):
    path = work_folder(spark, "t")
    nothing = spark.createDataFrame([], SCENES)
    ivf.ivf_build(nothing, path)
    ivf.ivf_append(nothing, path)
    assert ivf.ivf_candidates(spark, path, [1.0, 0.0], 4).count() == 0


def test_append_loses_nothing_and_repeats_nothing(spark, scenes):
    path = work_folder(spark, "t")
    ivf.ivf_build(scenes, path, nlist=4)
    n = ivf.ivf_rows(spark, path).count()
    short = scenes.limit(3).withColumn("embedding", F.slice("embedding", 1, 63))
    with pytest.raises(ValueError, match="length"):
        ivf.ivf_append(short, path)
    for _ in range(2):
        ivf.ivf_append(scenes.limit(7), path, batch="again")
    assert ivf.ivf_rows(spark, path).count() == n + 7
    ivf.ivf_build(scenes.limit(50), path, nlist=2)
    assert ivf.ivf_rows(spark, path).count() == 50
    assert ivf.ivf_exists(spark, path) and not ivf.ivf_exists(spark, f"{path}/none")


def test_batch_search_reads_the_cells_of_the_winners_again(spark, sf, cells):
    _, path = cells
    vectors = relation(spark, sf, "query_vectors").filter("query_id = 9")
    found = ivf.ivf_search_batch(spark, path, vectors, nprobe=2, key=ROW_PLACE)
    want = ivf.ivf_search_batch(spark, path, vectors, nprobe=2)
    shown = ["query_id", "rank", "title", "summary"]
    assert sorted(rows(found.select(shown))) == sorted(rows(want.select(shown)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in plan.replace("PartitionFilters: [], PushedFilters: [], ReadSchema: struct<query_id", "")
    assert "PartitionFilters: [coarse" in plan
