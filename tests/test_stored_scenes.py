"""How the registered queries store their scenes."""

from pathlib import Path

from clipatlas.plans import relations
from clipatlas.sources.tables import append_scenes, read_scenes

_HELD = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")


def test_scenes_are_sorted_in_small_tasks_and_not_shuffled(spark, sf, monkeypatch):
    seen, before = {}, [spark.conf.get(n) for n in _HELD]

    def kept(scenes, path, **more):
        seen.update(more, held=[spark.conf.get(n) for n in _HELD])
        append_scenes(scenes, path, **more)

    monkeypatch.setattr(relations, "append_scenes", kept)
    monkeypatch.setattr(relations, "_STORED", {})
    monkeypatch.setattr(relations, "STORED_ROWS", 50, raising=False)
    path = relations.stored_scenes(spark, sf)
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert not seen.get("by_video") and seen["held"] == [str(-(-events // 50)), "false"]
    assert [spark.conf.get(n) for n in _HELD] == before
    files = [f.name for f in Path(path.removeprefix("file://")).glob("*.parquet")]
    assert len(files) >= events // 50 - 1 and all(".zstd." in f for f in files)
    columns = ["title", "video_id", "embedding"]
    assert sorted(map(repr, read_scenes(spark, path).select(*columns).collect())) == sorted(map(repr, relations.relation(spark, sf, "scenes").select(*columns).collect()))
