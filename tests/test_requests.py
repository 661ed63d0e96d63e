import base64
import binascii
import random
import re

from clipatlas.sources.requests import decode_queries, plan_requests, select_query_input, split_requests


def test_plan_requests(spark):
    rows = [
        (1, "gs://b/in/a.mp4", "https://youtu.be/x"),
        (2, "gs://b/in/a.mp4", None),
        (3, "", "https://youtu.be/x"),
        (4, "", ""),
        (5, None, None),
        (6, "gs://b/dir/", None),
    ]
    df = spark.createDataFrame(rows, "request_id int, gcs_uri string, youtube_url string")
    got = {r.request_id: (r.accepted, r.video_id, r.source, r.source_type) for r in plan_requests(df).collect()}
    assert got[1] == (True, "a.mp4", "https://youtu.be/x", "youtube")
    assert got[2] == (True, "a.mp4", "gs://b/in/a.mp4", "gcs")
    assert got[3] == (True, "https://youtu.be/x", "https://youtu.be/x", "youtube")
    assert not got[4][0] and not got[5][0]
    assert got[6][:2] == (True, "")
    work, rejects = split_requests(df)
    assert sorted(r.request_id for r in work.collect()) == [1, 2, 3, 6]
    assert sorted(r.request_id for r in rejects.collect()) == [4, 5]


def test_select_query_input(spark):
    rows = [(1, "cat", "img"), (2, "cat", ""), (3, "", None), (4, None, "img"), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, query_text string, query_image string")
    assert {r.id: r["query"] for r in select_query_input(df).collect()} == {1: "img", 2: "cat", 4: "img"}


# A query, and the kind, type and bytes it stands for. The payload is read leniently: characters that are not of
# the alphabet are skipped, and what follows a complete padding is not looked at.
PNG = "data:image/png;base64,"
DECODED = {
    "cat": ("text", None, None),
    "data:image/png": ("text", None, None),
    "data:text/plain,YQ==": ("text", None, None),
    "data:image/png,": ("image", "image/png", b""),
    PNG + "aGVsbG8=": ("image", "image/png", b"hello"),
    PNG + "aGVsbG8=x": ("image", "image/png", b"hello"),
    PNG + "YQ==YQ==": ("image", "image/png", b"a"),
    PNG + "====": ("image", "image/png", b""),
    PNG + "abc": ("text", None, None),
    PNG + "aGVsbG8": ("text", None, None),
    PNG + "Y=Q=": ("text", None, None),
    PNG + "a===": ("text", None, None),
    PNG + "äÄ": ("text", None, None),
    "data:image/jpeg;base64,aGVs bG8=\n": ("image", "image/jpeg", b"hello"),
    "data:image/gif;a:b;base64,YWI=": ("image", "image/gif", b"ab"),
    PNG + base64.b64encode(bytes(range(256)) * 400).decode(): ("image", "image/png", bytes(range(256)) * 400),
}


def read_address(text):
    """The same for any payload, by a pattern for the address and the standard decoder for its bytes."""
    address = re.fullmatch(r"data:(image/[^;,:]*)[^,]*,(.*)", text, re.DOTALL)
    if address is None:
        return ("text", None, None)
    try:
        return ("image", address[1], binascii.a2b_base64(address[2]))
    except ValueError:
        return ("text", None, None)


def test_decode_queries(spark):
    rng = random.Random(5)
    payloads = ["".join(rng.choices("AQz0/+=== -", k=rng.randint(0, 12))) for _ in range(400)]
    wanted = {PNG + p: read_address(PNG + p) for p in payloads} | DECODED
    df = spark.createDataFrame([(q,) for q in wanted], "query string")
    for r in decode_queries(df).collect():
        image = bytes(r.image) if r.image is not None else None
        assert (r.kind, r.mime_type, image) == wanted[r["query"]], r["query"]
