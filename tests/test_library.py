"""From requests and uploads to search results, through the stored tables."""

import json

import pytest
from pyspark.sql import functions as F

from clipatlas import library as library_module
from clipatlas.library import Library
from clipatlas.operators import ivf, stats
from clipatlas.schemas import RESPONSE_SCENE_FIELDS
from clipatlas.streaming import ingest
from clipatlas.workdir import work_folder


def response(*descriptions):
    scenes = [{**{f: "" for f in RESPONSE_SCENE_FIELDS}, "title": d, "description": d, "start_timestamp": f"00:0{i}",
               "end_timestamp": f"00:1{i}", "category": "Beat"} for i, d in enumerate(descriptions)]
    return json.dumps({"summary": "about", "tags": ["x", "y"], "scenes": scenes})


def test_library(spark):
    library = Library(spark, work_folder(spark, "library"), bucket="bk")
    assert library.assets().count() == 0 and library.stats().count() == 6
    queries = spark.createDataFrame(
        [(1, "red car"), (2, "data:image/png;base64,aGVsbG8="), (3, "green dog")], "query_id int, query string"
    )
    assert library.search(queries).count() == 0

    requests = spark.createDataFrame(
        [(1, "gs://b/in/cars.mp4", None), (2, None, "https://youtu.be/dogs"), (3, None, None), (4, "gs://b/bad.mp4", None)],
        "request_id int, gcs_uri string, youtube_url string",
    )
    responses = spark.createDataFrame(
        [(1, response("a red car", "a blue car")), (2, response("green dog")), (4, "no json")],
        "request_id int, response string",
    )
    rejected = library.add_analyses(requests, responses).collect()
    assert [(r.request_id, r.video_id) for r in rejected] == [(4, "bad.mp4")]
    assert {r.video_id: r.tags for r in library.assets().collect()} == {
        "cars.mp4": ["x", "y"], "https://youtu.be/dogs": ["x", "y"],
    }
    assert [r.title for r in library.asset("cars.mp4").collect()] == ["a red car", "a blue car"]

    found = library.search(queries, k=1).collect()
    assert {(r.query_id, r.title) for r in found} == {(1, "a red car"), (3, "green dog")}
    with_images = Library(spark, library.root, load_image=lambda: lambda batch: [[1.0] * 64 for _ in batch])
    assert {r.query_id for r in with_images.search(queries).collect()} == {1, 2, 3}

    uploads = spark.createDataFrame([("a red car", "p.mp4"), ("a dog", "q.mp4")], "prompt_text string, filename string")
    library.add_prompts(uploads.withColumn("video_embedding", F.array_repeat(F.lit(0.0), 64)), "up")
    best = library.prompt_search(queries, k=1).collect()
    assert {(r.query_id, r.video_url) for r in best} == {
        (1, "https://storage.mtls.cloud.google.com/up/genAI_videos/p.mp4"),
        (3, "https://storage.mtls.cloud.google.com/up/genAI_videos/q.mp4"),
    }
    figures = {(r.metric, r.key): r.value for r in library.stats().collect()}
    assert figures[("total_scenes", "")] == 3 and figures[("total_prompt_videos", "")] == 2
    assert figures[("source_breakdown", "GCS")] == 1 and figures[("top_tags", "x")] == 3

    inbox = work_folder(spark, "inbox")
    late = spark.createDataFrame([("r", "late.mp4", "gcs", response("late scene"))],
                                 "response_id string, video_id string, source string, response string")
    late.write.json(inbox)
    library.stream_responses(inbox, work_folder(spark, "progress"), available_now=True).awaitTermination()
    assert library.asset("late.mp4").first().video_url.endswith("/bk/late.mp4")
    assert library.scenes.count() == 4
    assert library.rejects.count() == 1

    # One query at a time finds the same, and so do the clusters when all are looked through.
    want = [(r.title, r.distance) for r in library.search(queries.filter("query_id = 1"), k=3).orderBy("rank").collect()]
    assert [(r.title, r.distance) for r in library.find("red car", k=3).collect()] == want
    library.build_index(nlist=2)
    again = [(r.title, r.distance) for r in library.search(queries.filter("query_id = 1"), k=3, nprobe=9).orderBy("rank").collect()]
    assert again == want
    first = {r.video_id: r.play_url for r in library.first_scenes().collect()}
    assert first["cars.mp4"].startswith("https://storage.mtls.cloud.google.com/b/in/cars.mp4") and "embed" in first["https://youtu.be/dogs"]

    # What is stored later reaches the clusters once, also when its batch is repeated.
    more = spark.createDataFrame([("m.mp4", "gcs", response("a purple tree")), (None, "gcs", response("of nobody"))],
                                 "video_id string, source string, response string")
    for _ in range(2):
        assert [r.video_id for r in library.add_responses(more, batch="tree").collect()] == [None]
    assert library.scenes.count() == 5 and library.rejects.count() == 2
    trees = spark.createDataFrame([(1, "purple tree")], "query_id int, query string")
    assert [r.title for r in library.search(trees, k=2, nprobe=9).orderBy("rank").collect()][0] == "a purple tree"
    assert library.search(trees, k=10, nprobe=9).count() == 5
    figures = lambda df: sorted(map(repr, df.collect()))
    whole = figures(stats.stats(library.scenes, library.prompts))
    assert figures(library.stats()) == whole
    copy = library.compact(work_folder(spark, "copy"))
    assert figures(copy.stats()) == whole
    assert copy.scenes.count() == 5 and copy.rejects.count() == 2 and copy.prompts.count() == 2


def documents(spark, *rows):
    return spark.createDataFrame([(v, "gcs", response(d)) for v, d in rows], "video_id string, source string, response string")


def titles(library, spark, text="scene", **more):
    found = library.search(spark.createDataFrame([(1, text)], "query_id int, query string"), k=50, **more)
    return sorted(r.title for r in found.collect())


def test_batches_stored_while_an_index_is_built(spark, monkeypatch):
    library = Library(spark, work_folder(spark, "library"))
    library.add_responses(documents(spark, ("a", "scene one"), ("b", "scene two")), batch="first")
    build = ivf.ivf_write_build

    def slow_build(*args, **more):
        built = build(*args, **more)
        library.add_responses(documents(spark, ("c", "scene three")), batch="meanwhile")
        library.add_responses(documents(spark, ("d", "scene four")), batch="first")
        return built

    with monkeypatch.context() as patch:
        patch.setattr(ivf, "ivf_write_build", slow_build)
        # The second pass over what came meanwhile is left out first.
        patch.setattr(Library, "_extend", lambda *_: None)
        library.build_index(nlist=2)
    # Stored meanwhile, and so in no cell; replaced meanwhile, and so in a cell but not to be found.
    want = ["scene four", "scene three"]
    for more in ({}, {"nprobe": 5}, {"metric": "euclidean"}):
        assert titles(library, spark, **more) == want
    assert sorted(r.title for r in library.find("scene", k=9).collect()) == want
    library.extend_indexes()
    table = library._clustered(library_module._SCENES)
    assert table.loose is None and len(table.rows) == 3
    assert titles(library, spark) == want == titles(library, spark, nprobe=5)
    library.build_index(nlist=2)
    table = library._clustered(library_module._SCENES)
    assert table.loose is None and not table.stale and titles(library, spark) == want


def test_cells_of_a_library_follow_its_rows(spark):
    library = Library(spark, work_folder(spark, "library"))
    words = "red green blue car dog tree house sea sky road".split()
    text = lambda i: f"scene {words[i % 10]} {words[i // 10 % 10]} {i}"
    library.add_responses(documents(spark, *[(f"v{i}", text(i)) for i in range(40)]), batch="a")
    library.build_index(nlist=8)
    library.add_responses(documents(spark, *[(f"w{i}", "scene " + "far away " * (i % 5 + 1) + f"{i}") for i in range(300)]), batch="b")
    want = titles(library, spark, "far away")
    library.rebalance_indexes()
    table = library._clustered(library_module._SCENES)
    assert table.about.retired and table.loose is None and ivf.ivf_rows(spark, table).count() == 340
    assert titles(library, spark, "far away") == want
    # A batch whose rows were moved is replaced all the same.
    library.add_responses(documents(spark, ("v", "scene far away again")), batch="b")
    assert library.scenes.count() == 41 == ivf.ivf_rows(spark, library._clustered(library_module._SCENES)).count()
    assert titles(library, spark, "far away again")[0] and len(titles(library, spark, "far away again")) == 41


def test_a_failure_between_the_writes_shows_nothing(spark, monkeypatch):
    library = Library(spark, work_folder(spark, "library"))
    library.add_responses(documents(spark, ("a", "scene one"), (None, "scene of nobody")), batch="x")
    library.build_index(nlist=2)
    for place in ("scene_writer", "into_cells", "commit"):
        with monkeypatch.context() as patch:
            patch.setattr(ingest, place, lambda *_, **__: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                library.add_responses(documents(spark, ("b", "scene two"), (None, "another of nobody")), batch="x")
        assert [r.title for r in library.scenes.collect()] == titles(library, spark) == ["scene one"]
        assert library.rejects.count() == 1
    library.add_responses(documents(spark, ("b", "scene two")), batch="x")
    assert [r.title for r in library.scenes.collect()] == titles(library, spark) == ["scene two"] and library.rejects.count() == 0
    assert sorted(map(repr, library.stats().collect())) == sorted(map(repr, stats.stats(library.scenes, library.prompts).collect()))


def test_prompt_indexes(spark):
    library = Library(spark, work_folder(spark, "library"))
    uploads = [spark.createDataFrame([(f"{c} {n}", f"{c}{n}.mp4") for n in names], "prompt_text string, filename string").withColumn(
        "video_embedding", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.sin(i * F.length("prompt_text") + F.ascii("prompt_text")))
    ) for c, names in (("red", ["car", "dog", "house"]), ("green", ["tree", "car", "sea"]))]
    queries = spark.createDataFrame([(1, "red car"), (2, "sea"), (3, "the dog")], "query_id int, query string")
    found = lambda: sorted((r.query_id, r["rank"], r.video_url, round(r.best_distance, 9)) for r in library.prompt_search(queries).collect())
    library.add_prompts(uploads[0], "b", batch="one")
    library.build_prompt_index(nlist=2)
    library.add_prompts(uploads[1], "b", batch="two")
    library.add_prompts(uploads[1], "b", batch="two")
    assert library.prompts.count() == 6
    # Ids are new in every library, and rank prompts that are equally near.
    near = lambda rows: [(q, rank, distance) for q, rank, _, distance in rows]
    got = near(found())
    plain = Library(spark, work_folder(spark, "library"))
    plain.add_prompts(uploads[0].unionByName(uploads[1]), "b")
    assert got == sorted((r.query_id, r["rank"], round(r.best_distance, 9)) for r in plain.prompt_search(queries).collect())
    library.add_prompts(uploads[0].limit(1), "b", batch="two")
    assert library.prompts.count() == 4 and {u for _, _, u, _ in found()} <= {f"https://storage.mtls.cloud.google.com/b/genAI_videos/red{n}.mp4" for n in ("car", "dog", "house")}


def test_asset_skips_files_of_other_videos(spark):
    library = Library(spark, work_folder(spark, "library"))
    for i in range(6):
        docs = spark.createDataFrame([(f"v{i}{j}", "gcs", response(f"scene {i} {j}")) for j in range(0, 90, 9)], "video_id string, source string, response string")
        library.add_responses(docs)
    one = library.asset("v345")
    assert one.count() == 1
    rows = library.scenes.filter("video_id = 'v345'").select("title")
    rows.collect()
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() <= 10 < library.scenes.count()
