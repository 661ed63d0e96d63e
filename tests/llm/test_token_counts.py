"""The separator scan against a plain reading of the same files."""

import numpy as np
import public_tokenizers
import pytest

from clipatlas.llm import token_counts, vocabulary
from clipatlas.llm.byte_pairs import decode  # noqa: F401  the package is importable as a whole

END = 9


def plain(path, ids):
    found, start, place = [], 0, 0
    for i, x in enumerate(ids):
        if x == END:
            found.append((path, place, start, i - start, True))
            start, place = i + 1, place + 1
    if start < len(ids):
        found.append((path, place, start, len(ids) - start, False))
    return found


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("block", [4, 12, 64, 1 << 20])
def test_scan(spark, tmp_path, width, block):
    draw = np.random.default_rng(3)
    files = {
        "random": draw.integers(0, 12, 500), "none": draw.integers(0, 9, 70), "ends": np.full(40, END), "one": np.array([END]), "open": np.array([1, END, 2]),
        "long": np.concatenate([np.zeros(333, int), [END], np.zeros(200, int), [END, END]]),
    }
    expected = []
    for name, ids in files.items():
        path = tmp_path / f"{name}.bin"
        path.write_bytes(ids.astype("<u2" if width == 2 else "<u4").tobytes() + (b"\x01" if name == "random" else b""))
        expected += plain(name, ids.tolist())
    (tmp_path / "empty.bin").write_bytes(b"")
    rows = token_counts.count_tokens(token_counts.list_files(spark, str(tmp_path)), END, width, block).collect()
    assert sorted((r["path"].split("/")[-1][:-4], r["place"], r["first"], r["n_tokens"], r["ended"]) for r in rows) == sorted(expected)


def test_files_of_documents(spark, tmp_path):
    import tiktoken

    texts = ["hello world", None, "", "naïve café " * 5000, "hello world", "a\nb"]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)] + [(None, "zz", "x", 0)], "doc_id long, text string, path string, place int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    sent = vocabulary.send(spark, path)
    token_counts.write_flat_files(docs, f"file://{tmp_path}/flat", sent, public_tokenizers.PATTERN, 50256).write.parquet(f"{tmp_path}/order")
    order = spark.read.parquet(f"{tmp_path}/order")
    found = token_counts.count_tokens(token_counts.list_files(spark, f"{tmp_path}/flat"), 50256, block_bytes=32)
    name = lambda p: p.split("/")[-1]
    counts = {(name(r["path"]), r["place"]): r["n_tokens"] for r in found.collect()}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks(open(path, "rb").read()), special_tokens={})
    for r in order.collect():
        text = "zz" if r["doc_id"] is None else texts[r["doc_id"]]
        assert counts.pop((name(r["path"]), r["place"])) == len(encoding.encode_ordinary(text or ""))
    assert not counts


def test_no_files(spark, tmp_path):
    files = spark.createDataFrame([], "path string, length long")
    assert token_counts.count_tokens(files, END).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(files, END, width=3)
