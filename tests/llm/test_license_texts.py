"""Licence files in full, titles and versions."""

import pytest

from clipatlas.llm.licenses import FULL_TEXTS, scan_licenses


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    files = {f"/{name}/LICENSE": f"Copyright (c) 2019, The Authors.\nAll rights reserved.\n\n{texts[0]}" for name, texts in FULL_TEXTS.items()}
    files |= {f"/{name}/src/a.py": "x = 1" for name in FULL_TEXTS}
    files |= {
        "/t/agpl": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007", "/t/lgpl": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",
        "/t/gpl2": "This work is licensed under the GNU General Public License, version 2.", "/t/own": "All rights reserved.",
        "/t/inside": "Some words about it. Released under the MIT License. Then much other talk follows in this line. All rights reserved.",
        "/t/agplfile": "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n" + FULL_TEXTS["GPL-3.0"][0].split("\n", 2)[2].replace("GNU General", "GNU Affero General"),
    }
    files |= {f"/more/{i}": f"prose number {i} of the corpus, and to be or not" for i in range(300)}
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "doc_id long, path string, text string")
    rows = scan_licenses(spark, df, str(tmp_path_factory.mktemp("texts")))
    return {r["path"]: r["license"] for r in rows.collect()}


@pytest.mark.parametrize("name", sorted(FULL_TEXTS))
def test_full_texts(found, name):
    assert found[f"/{name}/LICENSE"] == found[f"/{name}/src/a.py"] == name


def test_titles_and_versions(found):
    wanted = {"agpl": "AGPL-3.0", "lgpl": "LGPL-3.0", "gpl2": "GPL-2.0", "own": "Proprietary", "inside": "MIT", "agplfile": "AGPL-3.0"}
    assert {k: found[f"/t/{k}"] for k in wanted} == wanted
    assert not any(found[f"/more/{i}"] for i in range(300))
