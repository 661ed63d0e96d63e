"""Repeated passages against all runs of words, wherever they begin."""

import random
import re

from clipatlas.llm import passages
from tests.llm.test_passages import brute

LONG = " ".join(f"alpha{i} beta{i * i}," for i in range(30))


def windows(rows, size, token=r"\S+"):
    """doc_id -> places of the words that a window of ``size`` words covers which is there before."""
    first, covered = {}, {}
    for d, text in sorted(rows):
        spans = [m.span() for m in re.finditer(token, text)]
        words = [text[a:b].lower() for a, b in spans]
        for i in range(len(words) - size + 1):
            where = first.setdefault(tuple(words[i : i + size]), (d, i))
            if where[0] != d or i - where[1] >= size:
                covered.setdefault(d, set()).update(x for a, b in spans[i : i + size] for x in range(a, b))
    return covered


def cut(spark, rows, folder, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = passages.whole_repeats(spark, docs, str(folder), **more)
    return spans.collect(), {r["doc_id"]: r["text"] for r in passages.without_repeats(docs, spans).collect()}


def test_passages_inside_lines(spark, tmp_path):
    rows = [(1, f"some words {LONG} and more"), (2, f"others before {LONG} then something else."), (3, f"Own. {LONG.upper()} end\nA line."), (4, f"x {LONG} y {LONG} z"), (5, "nothing here")]
    spans, texts = cut(spark, rows, tmp_path / "run")
    assert texts == {1: rows[0][1], 2: "others before then something else.", 3: "Own. end\nA line.", 4: "x y z", 5: "nothing here"}
    assert {(r["doc_id"], r["words"], r["first_doc_id"]) for r in spans} == {(2, 60, 1), (3, 60, 1), (4, 60, 1)}


def test_all_windows(spark, tmp_path):
    draw = random.Random(5)
    source = [f"w{draw.randrange(400)}" for _ in range(600)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(6):
            at, n = draw.randrange(500), draw.randrange(5, 60)
            words += source[at : at + n] + [draw.choice(["one.", "two", "three\n"]) + str(draw.randrange(10**6))]
        rows.append((d, " ".join(words)))
    for size in (25, 4):
        spans, _ = cut(spark, rows, tmp_path / str(size), min_words=size)
        wanted = windows(rows, size)
        for d, start, stop, _, _ in brute(rows, size):
            wanted.setdefault(d, set()).update(range(start, stop))
        texts, got = dict(rows), {}
        for r in spans:
            text = texts[r["doc_id"]]
            assert r["words"] == len(text[r["start"] : r["stop"]].split()) >= size
            got.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
        black = lambda cover: {d: {x for x in places if not texts[d][x].isspace()} for d, places in cover.items()}
        assert black(got) == black(wanted)


def test_text_without_blanks(spark, tmp_path):
    passage = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(80))
    rows = [(1, f"前{passage}后"), (2, f"另外{passage}结束"), (3, "短文" * 5)]
    assert cut(spark, rows, tmp_path / "run")[1] == {1: rows[0][1], 2: "另外结束", 3: rows[2][1]}


def test_given_documents_keep_no_fifty_words(spark, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    spans, texts = cut(spark, rows, tmp_path / "run")
    wanted, got = windows(rows, 50), {}
    for r in spans:
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    assert wanted and all(places <= got[d] for d, places in wanted.items()) and len(texts) == len(rows)
