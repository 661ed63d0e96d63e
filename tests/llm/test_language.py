"""Language by compression: accuracy on held-out rows, and edge texts."""

from pyspark.sql import functions as F

from clipatlas.llm.language import fold, identify, learn_dictionaries

WORDS = {"en": "the cat and the dog are sitting in this house with that thing ", "de": "der hund und die katze sitzen nicht in einem haus mit dem ding "}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = fold(F.col("doc_id"), 3) == 1
    found = identify(spark, docs, learn_dictionaries(docs.where(~held_out)))
    rows = docs.where(held_out).join(found, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["rejected"] == (r["score"] < 0.05) for r in rows)


def test_edges(spark):
    train = spark.createDataFrame([(1, "en", WORDS["en"] * 9), (2, "de", WORDS["de"] * 9), (3, None, "x"), (4, "fr", None), (None, "de", "und")], "doc_id long, lang string, text string")
    rows = [(1, WORDS["de"] * 4000), (2, None), (3, ""), (4, "12 34 !?"), (5, "the cat and the dog"), (5, "the cat and the dog"), (None, "nicht in einem haus")]
    docs = spark.createDataFrame([(*r, 0.5, "zz") for r in rows], "doc_id long, text string, score double, lang_pred string")
    dictionaries = learn_dictionaries(train)
    assert set(dictionaries) == {"en", "de"}
    got = [(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in identify(spark, docs, dictionaries).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == [(1, "de", True), (2, "und", False), (3, "und", False), (4, "und", False), (5, "en", True), (5, "en", True), (None, "de", True)]
    assert identify(spark, docs.limit(0), dictionaries).count() == 0
    assert {r["lang_pred"] for r in identify(spark, docs, learn_dictionaries(train.limit(0))).collect()} == {"und"}
    one = learn_dictionaries(train.where("lang = 'en'"))
    assert {r["score"] for r in identify(spark, docs.where("doc_id = 5"), one).collect()} == {1.0}


def test_sample_is_bounded(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("ab " * 100).alias("text"))
    assert len(learn_dictionaries(docs, documents=5, chars=10)["en"]) == 5 * 10 + 4
