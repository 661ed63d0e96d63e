"""Benchmark items in documents against plain Python."""

import re

import pytest

from clipatlas.llm.decontamination import bins_per_shingle, contained_items


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs, items, threshold=0.75):
    by_doc, by_item = {}, {}
    for d, t in docs:
        by_doc.setdefault(d, set()).update(runs(t))
    for i, t in items:
        by_item.setdefault(i, set()).update(runs(t))
    return {(d, i, len(s & q), len(q)) for d, s in by_doc.items() for i, q in by_item.items() if q and len(s & q) and len(s & q) >= threshold * len(q)}


def run(spark, docs, items, tmp_path, docs_schema="doc_id long, text string", items_schema="item_id long, text string", **more):
    found = contained_items(spark, spark.createDataFrame(docs, docs_schema), spark.createDataFrame(items, items_schema), str(tmp_path / "run"), **more)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan
    rows = found.collect()
    assert all(r["containment"] == r["shared"] / r["item_shingles"] for r in rows)
    got = [(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_given_tables(spark, tmp_path, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf{sf}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute(docs, items)
    assert expected and run(spark, docs, items, tmp_path) == expected


ITEM = "what is the name of the largest river in the whole country and where does it end"


def test_item_in_a_very_long_document(spark, tmp_path):
    filler = " ".join(f"f{i * 7919 % 100_003}" for i in range(150_000))
    docs = [(1, f"{filler}\n{ITEM.upper()}  {filler}"), (2, filler), (3, ITEM), (4, ITEM[: len(ITEM) // 3]), (5, ITEM.replace("end", "stop"))]
    assert run(spark, docs, [(9, ITEM)], tmp_path) == brute(docs, [(9, ITEM)])


def test_edges(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "two words"), (4, "two words"), (5, "Two\twords"), (6, "two words more"), (None, ITEM), (7, "a b c d e"), (8, f"x {ITEM}"), (9, "é à ü ö ß"), (10, "a b c d e " * 900)]
    items = [(1, "two words"), (2, None), (3, ""), (4, ITEM), (5, "A b C d E"), (5, "A b C d E"), (None, "É À ü ö ß"), (6, "a b c d e a b c d e")]
    got = run(spark, [(*r, 1, 2) for r in docs], [(*r, 5) for r in items], tmp_path, "doc_id long, text string, hash int, shared int", "item_id long, text string, shared int")
    assert got == brute(docs, items)


def test_large_items_are_not_broadcast(spark, tmp_path, monkeypatch):
    from clipatlas.llm import decontamination

    monkeypatch.setattr(decontamination, "_BROADCAST_ROWS", 0)
    docs = [(i, f"{i} {ITEM} tail" if i % 3 == 0 else f"{i} other") for i in range(90)]
    assert run(spark, docs, [(1, ITEM), (2, "nothing of this is there at all")], tmp_path) == brute(docs, [(1, ITEM)])


def test_empty(spark, tmp_path):
    assert run(spark, [], [(1, ITEM)], tmp_path / "a") == set()
    assert run(spark, [(1, ITEM)], [], tmp_path / "b") == set()


def test_bins():
    for smallest in (1, 2, 5, 11, 40, 400):
        crowd = 2.0 ** -bins_per_shingle(smallest)
        assert (crowd / 2) ** max(1, -(-3 * smallest // 4)) <= 1e-7 * 1.001
