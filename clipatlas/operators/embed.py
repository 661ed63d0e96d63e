"""Embedding text columns with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipatlas.schemas import VECTOR
from clipatlas.workdir import work_folder

# A model: a batch of texts (or images) in, as many vectors out.
Embedder = Callable[[Sequence], Sequence[Sequence[float]]]

HASH_DIMS = 64
# A text is hot if one in so many rows has it.
HOT_TEXTS = 1000
# Everything else counts as part of a word, in any script.
_BREAKS = r"[\x00-/:-@\[-`{-~]+"


def token_buckets(text: Column, dims: int = HASH_DIMS) -> Column:
    """Bucket of every word of a text, as text: the leading 32 bits of its MD5, modulo ``dims``."""
    words = F.filter(F.split(F.lower(text), _BREAKS), lambda w: w != "")
    return F.transform(
        words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dims).cast("string")
    )


def hash_embedding(rows: DataFrame, text_col: str, out_col: str, dims: int = HASH_DIMS) -> DataFrame:
    """Word counts per bucket, scaled to length 1; zeros for a text without words, [] for NULL.

    Needs no model, so it runs wherever Spark does.
    """
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dims)], "_buckets", "_counts")
    scaler = Normalizer(inputCol="_counts", outputCol="_scaled")
    buckets = F.coalesce(token_buckets(F.col(text_col), dims), F.array().cast("array<string>"))
    scaled = scaler.transform(counter.transform(rows.withColumn("_buckets", buckets)))
    vector = F.when(F.col(text_col).isNull(), F.array().cast(VECTOR)).otherwise(vector_to_array("_scaled"))
    return scaled.withColumn(out_col, vector).drop("_buckets", "_counts", "_scaled")


def embed(
    rows: DataFrame,
    text_col: str,
    out_col: str,
    load: Callable[[], Embedder] | None = None,
    dims: int = HASH_DIMS,
) -> DataFrame:
    """Attach an embedding of ``text_col``; NULL text gets an empty vector.

    ``load`` returns the model and is called once per task. Without it the hash embedding is used.
    """
    if load is None:
        return hash_embedding(rows, text_col, out_col, dims)

    @F.pandas_udf(VECTOR)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            known = texts.notna()
            vectors = pd.Series([[]] * len(texts), dtype=object)
            vectors[known.to_numpy()] = pd.Series(list(model(texts[known].tolist())), dtype=object).to_numpy()
            yield vectors

    return rows.withColumn(out_col, run(F.col(text_col)))


def embed_once(
    rows: DataFrame, text_col: str, out_col: str, load: Callable[[], Embedder] | None = None, dims: int = HASH_DIMS
) -> DataFrame:
    """As ``embed``, with each different text given to the model once, however many rows have it.

    The vectors of the texts are stored in the work folder and joined back to the rows. Texts of at least a
    thousandth of the rows, of which there are no more than a thousand, are joined by a broadcast, and their rows
    take no part in the shuffle by text: a hot text is no hot task. The hash embedding costs less than a
    shuffle and stays row by row.
    """
    if load is None:
        return embed(rows, text_col, out_col, load, dims)
    spark, folder = rows.sparkSession, work_folder(rows.sparkSession, "embedded")
    texts = rows.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("_text")).agg(F.count("*").alias("_rows"))
    embed(texts, "_text", "_vector", load, dims).write.parquet(folder)
    stored = spark.read.schema("_text string, _rows long, _vector array<double>").parquet(folder)
    total = stored.agg(F.sum("_rows")).scalar()
    hot = F.col("_rows") * HOT_TEXTS >= total
    often = F.broadcast(stored.filter(hot).select(F.col("_text").alias("_often"), F.col("_vector").alias("_known")))
    rest = stored.filter(~hot).select("_text", "_vector", F.lit(0).alias("_spread"))
    found = rows.join(often, F.col(text_col) == F.col("_often"), "left")
    # Rows that need no more have no text to be joined by, and are spread.
    done = F.col("_known").isNotNull() | F.col(text_col).isNull()
    keyed = found.withColumns({"_key": F.when(~done, F.col(text_col)), "_at": F.when(done, F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16)) + 1).otherwise(0).cast("int")})
    joined = keyed.join(rest, (F.col("_key") == F.col("_text")) & (F.col("_at") == F.col("_spread")), "left")
    vector = F.coalesce("_known", "_vector", F.array().cast("array<double>"))
    return joined.select(*rows.columns, vector.alias(out_col))


def embed_queries(
    decoded: DataFrame,
    load: Callable[[], Embedder] | None = None,
    load_image: Callable[[], Embedder] | None = None,
    dims: int = HASH_DIMS,
) -> DataFrame:
    """Attach ``query_embedding`` to decoded search requests.

    Text goes through ``load`` or the hash embedding and images through ``load_image``. Without a
    model for images theirs stays empty, and an empty vector finds nothing.
    """
    texts = embed(decoded.filter(F.col("kind") == "text"), "query", "query_embedding", load, dims)
    images = decoded.filter(F.col("kind") == "image")
    if load_image is None:
        images = images.withColumn("query_embedding", F.array().cast(VECTOR))
    else:
        images = embed(images, "image", "query_embedding", load_image)
    return texts.unionByName(images)
