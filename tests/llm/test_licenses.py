"""Licence scans against plain Python."""

import math
import re
from collections import Counter

from clipatlas.llm.licenses import TEMPLATES, scan_licenses


def words(text):
    return [w for w in re.split(r"[^a-z0-9.]+", re.sub(r"\.(?![0-9])", " ", text.lower())) if w]


def brute(files, threshold=0.6):
    templates = [(name, Counter(words(t))) for name in sorted(TEMPLATES) for t in TEMPLATES[name]]
    known = {w for _, t in templates for w in t}
    counts = Counter(w for _, _, t in files for w in set(words(t or "")) & known)
    idf = lambda w: math.log((1 + len(files)) / (1 + counts.get(w, 0))) + 1 if w in known else math.log(1 + len(files)) + 1

    def vector(c):
        v = {w: n * idf(w) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = [(name, vector(c)) for name, c in templates]
    own = []
    for _, _, text in files:
        best = (0, "")
        for unit in {*(text or "").split("\n"), *re.split(r"\n[ \t\r]*\n", text or "")}:
            if words(unit):
                v = vector(Counter(words(unit)))
                for name, t in vectors:
                    score = round(sum(x * t.get(w, 0) for w, x in v.items()), 9)
                    if score >= threshold and (score > best[0] or score == best[0] and name < best[1]):
                        best = (score, name)
        own.append(best)
    licensed = {}
    for (_, path, _), (score, name) in zip(files, own, strict=True):
        if name and path is not None and re.match(r"(?i)^(licen[sc]e|copying)([.\-_].*)?$", path.rpartition("/")[2]):
            folder = path.rpartition("/")[0]
            old = licensed.get(folder, (0, ""))
            if score > old[0] or score == old[0] and name < old[1]:
                licensed[folder] = (score, name)
    rows = []
    for (d, path, _), (score, name) in zip(files, own, strict=True):
        found = (None, None)
        if path is not None:
            parts = path.rpartition("/")[0].split("/")
            for n in range(len(parts), 0, -1):
                if "/".join(parts[:n]) in licensed:
                    found = (licensed["/".join(parts[:n])][1], "/".join(parts[:n]))
                    break
        rows.append((d, path, name or None, *found, name or found[0]))
    return rows


def run(spark, files, tmp_path, extra=()):
    df = spark.createDataFrame([(*f, *extra) for f in files], "doc_id long, path string, text string" + ", license string, unit int" * bool(extra))
    found = scan_licenses(spark, df, str(tmp_path / "run"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    return [(r["doc_id"], r["path"], r["own_license"], r["inherited_license"], r["inherited_from"], r["license"]) for r in found.collect()]


MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", TEMPLATES["GPL-3.0"][1]
FILES = [
    (1, "/a/LICENSE", MIT), (2, "/a/b/c.py", "print(1)"), (3, "/a/b/LICENCE.txt", f"Copyright me\n\n{GPL}"), (4, "/a/b/d/e/f.py", "x = 1"), (5, "/a/x.py", f"# {APACHE}\ncode\n"),
    (6, "/z/y.py", "nothing"), (7, "top.py", ""), (8, None, APACHE), (9, "/a/q.py", None), (10, "/n/LICENSE", "we have none"), (11, "/n/COPYING", "All Rights Reserved"), (12, "/n/m/k.py", "the license of the of"),
    (13, "/a/b/long.py", "word " * 100_000 + "\n" + MIT), (None, "/a/u.py", MIT), (14, "LICENSE", APACHE), (15, "/t/LICENSE", "licensed\nlicense mit\nCC BY 4.0"),
    (16, "/p/h.c", "/*\n * " + GPL.replace(" and/or", "\n * and/or").replace(" published", "\n * published") + "\n */\n\nint main;"),
]


def test_files(spark, tmp_path):
    key = lambda r: tuple(map(str, r))
    assert sorted(run(spark, FILES, tmp_path, ("old", 3)), key=key) == sorted(brute(FILES), key=key)


def test_given_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    files = [(r["doc_id"], f"/{r['source']}/{r['doc_id'] % 7}/{'LICENSE' if r['doc_id'] % 5 == 0 else r['doc_id']}", r["text"]) for r in docs]
    got = run(spark, files, tmp_path)
    assert sorted(got) == sorted(brute(files)) if all(None not in g for g in got) else sorted(map(str, got)) == sorted(map(str, brute(files)))
    notices = {"Apache-2.0": APACHE, "MIT": MIT, "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "Proprietary": "All rights reserved."}
    by_id = {r[0]: r[2] for r in got}
    for name, notice in notices.items():
        for r in docs:
            if notice in r["text"].split("\n"):
                assert by_id[r["doc_id"]] is not None


def test_repeated_and_empty(spark, tmp_path):
    assert run(spark, [], tmp_path / "a") == []
    rows = [(1, "/a/LICENSE", MIT)] * 3 + [(2, "/a/f", "x")] * 2
    got = run(spark, rows, tmp_path / "b")
    assert sorted(set(got)) == [(1, "/a/LICENSE", "MIT", "MIT", "/a", "MIT"), (2, "/a/f", None, "MIT", "/a", "MIT")] and len(got) == 5
