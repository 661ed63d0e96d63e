"""Edge values of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from clipatlas.functions import labels, links, timecodes, vectors
from clipatlas.operators.search import prompt_search_score

HOST = "https://storage.mtls.cloud.google.com"


def apply(spark, schema, rows, *exprs):
    names = [c.split()[0] for c in schema.split(",")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}")
    cols = [F.col(n) for n in names]
    out = df.select("_i", *[e(*cols).alias(f"o{j}") for j, e in enumerate(exprs)]).orderBy("_i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out]


def test_timestamp_seconds(spark):
    cases = {
        None: 0, "": 0, "01:23": 83, "1:02:03": 3723, "45": 45, "1:2:3:4": 1, "xx:10": 0, "1.5:10": 0,
        " 5 ": 5, "1_0": 10, "-1:56": -4, "1__0": 0, "_1": 0, "+2:03": 123, "1:": 0, ":5": 0, "1:2:x": 0, "x": 0,
        "9" * 30: 10**30 - 1, "\t7\n:1": 421, "0000000000007": 7, "1000000000000": 10**12, "0" * 50 + "12:" + "0" * 20 + "3": 723,
        "1:1000000000000000:0": 3600 + 60 * 10**15, "1_000_000_000_000_000": 10**15, "\u30005\u00a0": 5, "\u20287:\x1f1": 421,
        "\u0661\u0662:\uff10\uff13": 723, "\u0663_\u0660": 30, "1 2": 0, "\u200b5": 0,
    }
    got = apply(spark, "t string", [(k,) for k in cases], timecodes.timestamp_seconds)
    assert got == list(cases.values())


def test_seconds_of_many_scenes_are_added_exactly(spark):
    df = spark.createDataFrame([("0", str(10**20 + i)) for i in range(100)], "s string, e string")
    total = df.agg(F.sum(timecodes.scene_duration(F.col("s"), F.col("e")))).first()[0]
    assert total == sum(10**20 + i for i in range(100))


def test_timestamp_seconds_lenient(spark):
    cases = {None: 0.0, "": 0.0, "1.5:10": 100.0, ":10": 10.0, "xx": 0.0, "xx:10": None, "1:02:03": 3723.0,
             "1e1": 10.0, " : 5 ": 5.0, "1:2:3:4": 1.0, "1_0:1": None, ".5": 0.5}
    got = apply(spark, "t string", [(k,) for k in cases], timecodes.timestamp_seconds_lenient)
    assert got == list(cases.values())


def test_scene_duration(spark):
    cases = [("00:10", "00:25", 15), ("00:25", "00:10", 0), ("", "", 0), (None, "00:07", 7)]
    got = apply(spark, "s string, e string", [c[:2] for c in cases], timecodes.scene_duration)
    assert got == [c[2] for c in cases]


def test_format_duration(spark):
    cases = {None: "0s", 0: "0s", 59: "59s", 60: "1m 0s", 3723: "1h 2m 3s", 3600: "1h 0m 0s"}
    got = apply(spark, "s long", [(k,) for k in cases], timecodes.format_duration)
    assert got == list(cases.values())


def test_source_class(spark):
    cases = {None: "Local", "": "Local", "GCS": "GCS", "gs://b/a.mp4": "GCS", "gs://b/YouTube.mp4": "YouTube",
             "https://x/y": "YouTube", "youtube": "YouTube", "local": "Local", "gcs2": "Local"}
    got = apply(spark, "s string", [(k,) for k in cases], links.source_class)
    assert got == list(cases.values())


def test_scene_video_url(spark):
    rows = [("gs://b/a", "v"), ("gcs", "v"), (None, "v"), ("", "v"), ("https://x", "v"), ("gs://b/gs://c", "v")]
    got = apply(
        spark, "s string, v string", rows,
        lambda s, v: links.scene_video_url(s, v, "bucket"), lambda s, v: links.scene_video_url(s, v),
    )
    assert got == [
        (f"{HOST}/b/a", f"{HOST}/b/a"), (f"{HOST}/bucket/v", "gcs"), ("", ""), ("", ""),
        ("https://x", "https://x"), (f"{HOST}/b/c", f"{HOST}/b/c"),
    ]


def test_prompt_video_url(spark):
    assert apply(spark, "s string", [("gs://b/a",), ("https://x",), (None,)], links.prompt_video_url) == [
        f"{HOST}/b/a", "", "",
    ]


@pytest.fixture
def embeds(spark):
    def run(*rows):
        return apply(spark, "u string, t string", rows, links.youtube_embed_url)

    return run


def test_youtube_embed_url(embeds):
    prefix = "https://www.youtube.com/embed/"
    cases = {
        "https://www.youtube.com/watch?v=abc&t=1": "abc",
        "https://www.YouTube.com/watch?t=1&v=abc#x": "abc",
        "https://www.youtube.com/watch?vv=no&v=a&v=b": "a",
        "https://www.youtube.com/watch?v=&v=b": "",
        "https://www.youtube.com/watch#?v=b": "",
        "https://user@m.youtube.com:443/watch?v=abc": "abc",
        "https://youtu.be/xyz?t=3": "xyz",
        "https://youtu.be/xyz/more": "xyz",
        "https://youtu.be": "",
        "https://youtu.be//xyz": "",
        "https://example.com/youtube.com?v=abc": "",
        "abc": "abc", "a/b": "", "": "", None: "", "gs://b/x": "",
    }
    got = embeds(*[(u, "01:00") for u in cases])
    assert got == [f"{prefix}{v}?start=60" if v else "" for v in cases.values()]
    assert embeds(("abc", "xx:10"), ("abc", "0:1.5"), ("abc", None)) == [
        f"{prefix}abc?start=NaN", f"{prefix}abc?start=1.5", f"{prefix}abc?start=0",
    ]


def test_playback_url(spark):
    rows = [("https://h/a.mp4", "v", "01:05"), ("", "https://h/b.mp4", ""), ("gcs", "v", "1"),
            ("https://youtu.be/q", "v", "5"), (None, None, None)]
    assert apply(spark, "u string, v string, t string", rows, links.playback_url) == [
        "https://h/a.mp4#t=65", "https://h/b.mp4#t=0", "", "https://www.youtube.com/embed/q?start=5", "",
    ]


def test_storage_uri(spark):
    got = apply(spark, "n string", [("a.mp4",)], lambda n: links.storage_uri("b", n),
                lambda n: links.storage_uri("b", n, links.PROMPT_VIDEO_PREFIX))
    assert got == [("gs://b/a.mp4", "gs://b/genAI_videos/a.mp4")]


def test_tags(spark):
    got = apply(spark, "t string", [("a, b,,",), ("",), (None,), (" ",)], labels.tags_split, labels.tags_clean)
    assert got == [(["a", " b", "", ""], ["a", "b"]), ([], []), ([], []), ([" "], [])]
    blanks = ["\u3000b ", "\u00a0b", "b\u2028", "\x1fb\x1c", "\u2003b\u205f", "\u200bb"]
    got = apply(spark, "t string", [("a," + b,) for b in blanks], labels.tags_clean)
    assert got == [["a", "b"]] * 5 + [["a", "\u200bb"]]


def short_id(text):
    """The rolling hash worked out in plain Python."""
    if not text:
        return "Unknown"
    h = 0
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    return f"ASSET-{abs(h):X}"[:12]


def test_short_asset_id(spark):
    texts = ["", None, "a", "clip.mp4", "https://www.youtube.com/watch?v=dQw4w9WgXcQ", "Ä中", "x\U0001f600y", "z" * 300]
    got = apply(spark, "t string", [(t,) for t in texts], labels.short_asset_id)
    assert got[:5] == ["Unknown", "Unknown", "ASSET-61", "ASSET-36A30B", "ASSET-6C8E3C"]
    assert got == [short_id(t) for t in texts]


def test_cosine(spark):
    v, zero, other = [1.0, 2.0], [0.0, 0.0], [-2.0, 1.0]
    rows = [(v, v), (v, zero), (v, other), (v, [-1.0, -2.0]), (v, [float("nan"), 1.0]), (None, v)]
    got = apply(spark, "a array<double>, b array<double>", rows, vectors.cosine_similarity)
    assert got[-1] is None
    assert [round(x, 9) for x in got[:-1]] == [1.0, 0.0, 0.0, -1.0, 0.0]
    flipped = apply(spark, "a array<double>, b array<double>", [r[::-1] for r in rows], vectors.cosine_similarity)
    assert flipped == got
    fixed = apply(spark, "a array<double>", [(r[0],) for r in rows], lambda a: vectors.cosine_to(a, other))
    assert fixed[0] == 0.0 and fixed[-1] is None


def test_euclidean(spark):
    got = apply(spark, "a array<double>, b array<double>", [([0.0, 0.0], [3.0, 4.0])], vectors.euclidean_distance)
    assert got == [5.0]


def test_embedding_codec(spark):
    vector = [0.1, -1e-300, 3.0, math.pi]
    assert apply(spark, "v array<double>", [(vector,)],
                 lambda v: vectors.decode_embedding(vectors.encode_embedding(v))) == [vector]
    bad = [(t,) for t in ("", "x", '["a"]', "[1,", None)]
    got = apply(spark, "t string", bad, lambda t: vectors.usable(vectors.decode_embedding(t)))
    assert not any(got)


def test_prompt_search_score(spark):
    assert apply(spark, "d double", [(0.25,), (None,)], prompt_search_score) == [0.75, 1.0]
