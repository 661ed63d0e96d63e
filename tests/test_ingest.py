import json
import os
import uuid
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipatlas.operators.embed import embed, embed_once
from clipatlas.plans.relations import relation, responses
from clipatlas.schemas import PROMPTS, RESPONSE_SCENE_FIELDS, SCENE_REQUIRED, SCENES
from clipatlas.sources.tables import (
    append_prompts,
    append_scenes,
    ensure_tables,
    read_prompts,
    read_scenes,
    split_required,
)
from clipatlas.streaming.ingest import ingested, parsed_documents, scenes_and_rejects, stream_ingest
from clipatlas.workdir import work_folder


def sorted_rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_append_adds_exactly_its_rows(spark, sf):
    scenes = relation(spark, sf, "scenes")
    path = work_folder(spark, "t")
    for i in (1, 2):
        append_scenes(scenes, path, by_video=i == 2, required=())
        assert read_scenes(spark, path).count() == i * scenes.count()
    assert sorted_rows(read_scenes(spark, path).distinct()) == sorted_rows(scenes.select(*SCENES.fieldNames()))


def test_filter_on_video_reaches_the_files(spark, sf):
    path = work_folder(spark, "t")
    append_scenes(relation(spark, sf, "scenes"), path, by_video=True, required=())
    one = read_scenes(spark, path).filter(F.col("video_id") == "vid_3.mp4").select("title")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(video_id,vid_3.mp4)" in plan
    assert "ReadSchema: struct<video_id:string,title:string>" in plan


def test_prompts_get_new_ids(spark, sf):
    path = work_folder(spark, "t")
    prompts = relation(spark, sf, "prompts").drop("id", "created_at")
    append_prompts(prompts, path)
    append_prompts(prompts, path)
    stored = read_prompts(spark, path)
    assert stored.columns == PROMPTS.fieldNames()
    assert stored.select("id").distinct().count() == 2 * prompts.count()
    assert stored.filter(F.col("created_at").isNull()).count() == 0


def test_tables_are_created_once(spark):
    folder = work_folder(spark, "t")
    first = ensure_tables(spark, "made_twice", folder)
    assert sorted_rows(first) == sorted_rows(ensure_tables(spark, "made_twice", folder))
    assert first.count() == len(SCENES) + len(PROMPTS)
    assert spark.table("made_twice.prompts").count() == 0


def test_required_fields(spark, sf):
    scenes = relation(spark, sf, "scenes")
    kept, rejected = split_required(scenes, SCENE_REQUIRED)
    assert kept.count() + rejected.count() == scenes.count()
    assert rejected.count() == scenes.filter("source IS NULL").count() > 0
    path = work_folder(spark, "t")
    append_scenes(scenes, f"{path}/scenes", rejects=f"{path}/rejects")
    assert read_scenes(spark, f"{path}/scenes").count() == kept.count()
    assert read_scenes(spark, f"{path}/rejects").count() == rejected.count()
    with pytest.raises(Exception, match="lacks one of"):
        append_scenes(scenes, f"{path}/strict")
    append_scenes(kept, f"{path}/strict")
    assert read_scenes(spark, f"{path}/strict").count() == kept.count()


def test_hash_embedding(spark):
    texts = ["a b a", "A, b!", "", None, "ü ü x", "word " * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.v for r in embed(df, "text", "v", dims=16).collect()}
    assert got[3] == [] and got[2] == [0.0] * 16
    for i in (0, 1, 4, 5):
        assert len(got[i]) == 16 and abs(np.linalg.norm(got[i]) - 1) < 1e-12
    assert sorted(x for x in got[0] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5])
    assert max(got[5]) == 1.0
    spread = embed(df.repartition(3), "text", "v", dims=16)
    assert {r.id: r.v for r in spread.collect()} == got


def test_pluggable_model(spark):
    def load():
        return lambda batch: [[float(len(t)), 1.0] for t in batch]

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "id int, text string").repartition(1)
    assert {r.id: r.v for r in embed(df, "text", "v", load).collect()} == {1: [3.0, 1.0], 2: [], 3: [0.0, 1.0]}


@pytest.mark.parametrize("hot_texts", [1000, 0])
def test_each_text_is_embedded_once(spark, tmp_path, monkeypatch, hot_texts):
    monkeypatch.setattr("clipatlas.operators.embed.HOT_TEXTS", hot_texts)
    seen = tmp_path / "seen"
    seen.mkdir()

    def load():
        def model(batch):
            (seen / uuid.uuid4().hex).write_text("\n".join(batch))
            return [[float(len(t)), 1.0] for t in batch]

        return model

    texts = ["hot text"] * 2000 + [f"text {i % 700}" for i in range(3000)] + [None] * 500 + [""] * 5
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, other string").repartition(5)
    got = embed_once(df, "text", "v", load)
    rows = got.collect()
    assert got.columns == ["id", "text", "other", "v"] and len(rows) == len(texts)
    assert {r.id: r.v for r in rows} == {i: [] if t is None else [float(len(t)), 1.0] for i, t in enumerate(texts)}
    asked = [line for f in seen.iterdir() for line in f.read_text().split("\n")]
    assert sorted(asked) == sorted(set(t for t in texts if t is not None))
    assert embed_once(df.limit(0), "text", "v", load).count() == 0
    if hot_texts:
        hot = got.filter("text = 'hot text'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert hot > 1


def test_stream_equals_batch_and_repeats_nothing(spark, sf):
    inbox, target, progress = (work_folder(spark, n) for n in ("inbox", "target", "progress"))
    documents = responses(spark, sf)
    documents.repartition(3).write.json(inbox)

    def drain():
        stream_ingest(spark, inbox, target, progress, max_files_per_trigger=1, available_now=True).awaitTermination()

    drain()
    scenes, rejects = scenes_and_rejects(parsed_documents(documents))
    want, refused = sorted_rows(scenes), sorted_rows(rejects)
    stored = ingested(spark, target)
    assert sorted_rows(stored.drop("ingest_batch", "ingest")) == want
    assert stored.select("ingest_batch").distinct().count() == 3
    assert sorted_rows(ingested(spark, target, "rejects").drop("ingest_batch", "ingest", "broken_record")) == refused
    drain()
    assert sorted_rows(ingested(spark, target).drop("ingest_batch", "ingest")) == want

    # A batch whose commit was lost is done again and replaces what it had written.
    os.remove(f"{progress}/commits/2")
    crc = f"{progress}/commits/.2.crc"
    if os.path.exists(crc):
        os.remove(crc)
    drain()
    assert sorted_rows(ingested(spark, target).drop("ingest_batch", "ingest")) == want

    late = {"response_id": "late", "video_id": "v", "source": "gcs", "response": "not json"}
    with open(f"{inbox}/late.json", "w") as f:
        f.write(json.dumps(late) + "\n")
    drain()
    assert len(sorted_rows(ingested(spark, target, "rejects"))) == len(refused) + 1


def one_scene(title):
    scene = {**dict.fromkeys(RESPONSE_SCENE_FIELDS, ""), "title": title}
    return json.dumps({"summary": "s", "tags": ["t"], "scenes": [scene]})


def test_streams_do_not_replace_each_other(spark):
    inboxes = [work_folder(spark, f"inbox{i}") for i in (1, 2)]
    target, progress = work_folder(spark, "target"), [work_folder(spark, f"progress{i}") for i in (1, 2, 3)]

    def drain(inbox, checkpoint):
        stream_ingest(spark, inbox, target, checkpoint, available_now=True).awaitTermination()

    for i, inbox in enumerate(inboxes):
        os.makedirs(inbox)
        lines = [
            json.dumps({"response_id": f"r{i}", "video_id": f"v{i}", "source": "gcs", "response": one_scene(f"good {i}")}),
            json.dumps({"response_id": f"n{i}", "source": None, "response": one_scene("of nobody")}),
            f"broken {i} {{",
        ]
        with open(f"{inbox}/a.json", "w") as f:
            f.write("\n".join(lines) + "\n")
        drain(inbox, progress[i])
    stored, rejects = ingested(spark, target), ingested(spark, target, "rejects")
    assert sorted(r.title for r in stored.collect()) == ["good 0", "good 1"]
    assert sorted((r.response_id or "", r.broken_record or "") for r in rejects.collect()) == [
        ("", "broken 0 {"), ("", "broken 1 {"), ("n0", ""), ("n1", ""),
    ]
    # A stream that lost its checkpoint reads its inbox again; it adds to what is there and replaces nothing.
    drain(inboxes[0], progress[2])
    assert sorted(r.title for r in ingested(spark, target).collect()) == ["good 0", "good 0", "good 1"]


def test_work_folder(spark):
    a, b = work_folder(spark, "x"), work_folder(spark, "x")
    assert a != b and "/x-" in a


def test_work_folder_of_a_cluster():
    def session(master, shared):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default: shared if name == "spark.checkpoint.dir" else default),
            sparkContext=SimpleNamespace(master=master),
        )

    assert work_folder(session("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(session("yarn", None), "x")
    assert work_folder(session("local[2]", None), "x").startswith("/")
