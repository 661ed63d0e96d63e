import json

from clipatlas.schemas import RESPONSE_SCENE_FIELDS, SCENE_TEXT_COLUMNS
from clipatlas.sources.responses import to_scene_rows
from clipatlas.streaming.ingest import parsed_documents, scenes_and_rejects


def scene(**changes):
    return {**{f: f"{f}!" for f in RESPONSE_SCENE_FIELDS}, **changes}


def document(**changes):
    return {**{"summary": "s", "tags": ["a", "b"], "scenes": [scene(), scene(title="second")]}, **changes}


GOOD = {
    "plain": json.dumps(document()),
    "blank around": "  " + json.dumps(document()) + "\n",
    "more fields": json.dumps(document(extra={"x": 1})),
    "no scenes": json.dumps(document(scenes=[])),
    "no tags": json.dumps(document(tags=[])),
    "empty text": json.dumps(document(summary="")),
    "many": json.dumps(document(scenes=[scene(title=f"t{i:04}") for i in range(2000)])),
}
BAD = {
    "no json": "nope",
    "empty": "",
    "null": None,
    "cut": json.dumps(document())[:-1],
    "list": "[" + json.dumps(document()) + "]",
    "two": json.dumps(document()) + json.dumps(document()),
    "two with comma": json.dumps(document()) + "," + json.dumps(document()),
    "words after": json.dumps(document()) + " and that was all",
    "bracket after": json.dumps(document()) + "]",
    "single quotes": str(document()),
    "no summary": json.dumps({k: v for k, v in document().items() if k != "summary"}),
    "null summary": json.dumps(document(summary=None)),
    "number": json.dumps(document(summary=5)),
    "tags text": json.dumps(document(tags="a,b")),
    "tag number": json.dumps(document(tags=["a", 1])),
    "null tags": json.dumps(document(tags=None)),
    "scenes text": json.dumps(document(scenes="none")),
    "scene text": json.dumps(document(scenes=["x"])),
    "scene null": json.dumps(document(scenes=[scene(), None])),
    "object title": json.dumps(document(scenes=[scene(title={"a": 1})])),
    "no pacing": json.dumps(document(scenes=[scene(), {k: v for k, v in scene().items() if k != "pacing"}])),
}


def test_whole_documents_are_accepted_or_rejected(spark):
    rows = [(n, "v", "gcs", t) for n, t in {**GOOD, **BAD}.items()]
    df = spark.createDataFrame(rows, "response_id string, video_id string, source string, response string")
    parsed = parsed_documents(df)
    valid = parsed.filter("accepted")
    stored, rejects = scenes_and_rejects(parsed)
    assert stored.count() == sum(len(json.loads(t)["scenes"]) for t in GOOD.values())
    assert {r.response_id for r in valid.collect()} == set(GOOD)
    assert {r.response_id: r.response for r in rejects.collect()} == BAD

    scenes = to_scene_rows(valid, keep=("response_id",)).orderBy("response_id", "position").collect()
    by_document = {}
    for r in scenes:
        by_document.setdefault(r.response_id, []).append(r)
    assert "no scenes" not in by_document
    assert [r.title for r in by_document["many"]] == [f"t{i:04}" for i in range(2000)]
    first = by_document["plain"][0].asDict()
    assert first["timestamp_start"] == "start_timestamp!" and first["timestamp_end"] == "end_timestamp!"
    assert (first["tags"], first["summary"], first["source"]) == ("a,b", "s", "gcs")
    assert by_document["no tags"][0].tags == ""
    assert set(SCENE_TEXT_COLUMNS) <= set(first)
