"""Repeated passages against a plain reading of the same rule."""

import re

from clipatlas.llm import passages


def units(text):
    found, start = [], 0
    cuts = [m.span() for m in re.finditer(r"\s*\n\s*|(?<=[.!?])\s+", text or "")] + [(len(text or ""), 0)]
    for stop, after in cuts:
        words = (text or "")[start:stop].lower().split()
        if words:
            found.append((start, stop, " ".join(words), len(words)))
        start = after
    return found


def brute(rows, min_words):
    """doc_id -> spans, where the smallest doc_id and then the first place keep a unit."""
    ranked, first = sorted(rows), {}
    for d, t in ranked:
        for place, u in enumerate(units(t)):
            first.setdefault(u[2], (d, place))
    spans = set()
    for d, t in ranked:
        run = []
        for place, u in [*enumerate(units(t)), (None, None)]:
            if u is not None and first[u[2]] != (d, place):
                run.append((u, first[u[2]][0]))
                continue
            if run and sum(x[3] for x, _ in run) >= min_words:
                spans.add((d, run[0][0][0], run[-1][0][1], sum(x[3] for x, _ in run), run[0][1]))
            run = []
    return sorted(spans)


def found(spark, docs, tmp_path, name, **more):
    spans = passages.repeated_spans(spark, docs, f"{tmp_path}/{name}", **more)
    rows = [(r["doc_id"], r["start"], r["stop"], r["words"], r["first_doc_id"]) for r in spans.collect()]
    return spans, sorted(rows, key=lambda r: (r[0] is None, r))


def test_given_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for min_words in (25, 3):
        spans, got = found(spark, docs, tmp_path, f"run{min_words}", min_words=min_words)
        assert got == brute(rows, min_words)
        cut = {}
        for d, start, stop, _, _ in got:
            cut.setdefault(d, []).append((start, stop))
        cleaned = {r["doc_id"]: (r["text"], r["n_chars"]) for r in passages.without_repeats(docs, spans).collect()}
        assert len(cleaned) == len(rows)
        for d, t in rows:
            kept, at = "", 0
            for start, stop in sorted(cut.get(d, [])):
                kept, at = kept + t[at:start], stop
                at += len(t[at:]) - len(t[at:].lstrip())
            assert cleaned[d] == (kept + t[at:], len(kept + t[at:]))


PASSAGE = "This passage is in many documents and has a lot of words in it. It goes on for a second sentence, which is long as well, and ends. Then comes the third one to make it more than fifty words in all, so that nobody can say that it is short."


def test_passage_within_lines(spark, tmp_path):
    rows = [(1, f"Own start here. {PASSAGE} Own end one.\nMore."), (2, PASSAGE), (3, f"Other words\n{PASSAGE.upper()}"), (4, "Clean text. Own start here."), (5, f"no stop before {PASSAGE} after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans, got = found(spark, docs, tmp_path, "run")
    assert {g[0] for g in got} == {2, 3, 5} and {g[4] for g in got} == {1}
    cleaned = {r["doc_id"]: r["text"] for r in passages.without_repeats(docs, spans).collect()}
    assert cleaned[1] == rows[0][1] and cleaned[4] == rows[3][1] and cleaned[2] == "" and cleaned[3] == "Other words\n"
    assert "third one" not in cleaned[5] and cleaned[5].startswith("no stop before") and "n_chars" not in docs.columns


def test_edges(spark, tmp_path):
    line = "word " * 30
    rows = [(1, None), (2, ""), (3, "\n\n. ."), (4, line), (4, line), (5, f"{line}\n{line}\n{line}"), (None, line), (6, "long words here. " * 40_000), (7, " " + line), (8, "x. " * 5)]
    docs = spark.createDataFrame([(d, t, "s", 1, None) for d, t in rows], "doc_id long, text string, start string, version int, n_chars int")
    spans, got = found(spark, docs.where("doc_id IS NOT NULL"), tmp_path, "run")
    assert got == brute([r for r in rows if r[0] is not None], 25)
    spans, _ = found(spark, docs, tmp_path, "all")
    cleaned = passages.without_repeats(docs, spans)
    assert cleaned.columns == docs.columns
    by_id = {}
    for r in cleaned.collect():
        by_id.setdefault(r["doc_id"], []).append(r["text"])
    assert by_id[4] == [line, line] and by_id[None] == [""] and by_id[1] == [None] and by_id[2] == [""] and by_id[5] == [""]
    assert len(by_id[6][0]) < 20
    none = docs.limit(0)
    spans, got = found(spark, none, tmp_path, "none")
    assert got == [] and passages.without_repeats(none, spans).count() == 0
