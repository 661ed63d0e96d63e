"""Analysis requests and search requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def plan_requests(requests: DataFrame) -> DataFrame:
    """Work out what each request asks for; ``accepted`` is false when no address is given.

    With both addresses the hosted one is analysed and stored as the source, while the id still
    comes from the object's file name.
    """
    gcs, youtube = _given(F.col("gcs_uri")), _given(F.col("youtube_url"))
    return (
        requests.withColumn("accepted", gcs.isNotNull() | youtube.isNotNull())
        .withColumn("video_id", F.coalesce(F.element_at(F.split(gcs, "/"), -1), youtube))
        .withColumn("source", F.coalesce(youtube, gcs))
        .withColumn(
            "source_type",
            F.when(youtube.isNotNull(), F.lit("youtube")).when(gcs.isNotNull(), F.lit("gcs")),
        )
    )


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work items, and the rejected requests as they came."""
    planned = plan_requests(requests)
    return planned.filter("accepted").drop("accepted"), planned.filter("NOT accepted").select(*requests.columns)


def select_query_input(requests: DataFrame, text_col: str = "query_text", image_col: str = "query_image") -> DataFrame:
    """The image if there is one, else the text, as ``query``; empty requests drop out."""
    query = F.coalesce(_given(F.col(image_col)), _given(F.col(text_col)))
    return requests.withColumn("query", query).filter(F.col("query").isNotNull())


def _base64_bytes(encoded: Column) -> Column:
    """Bytes of base64 text, or NULL when its padding is wrong.

    Characters outside the alphabet are skipped. Padding that completes a group of four ends the
    data; padding elsewhere is skipped too.
    """
    kept = F.regexp_replace(encoded, "[^A-Za-z0-9+/=]", "")
    runs = F.split(kept, "=")
    # After each run of letters but the last comes one '='. Follow the letters so far, the '=' signs
    # in a row, and the letters there were when a group was completed.
    start = F.struct(
        F.lit(0).alias("letters"), F.lit(0).alias("pads"), F.lit(None).cast("int").alias("ended")
    )

    def step(state: Column, run: Column) -> Column:
        letters = state["letters"] + F.length(run)
        pads = F.when(F.length(run) > 0, F.lit(0)).otherwise(state["pads"])
        counted = F.when(letters % 4 >= 2, pads + 1).otherwise(pads)
        ended = F.when((letters % 4 >= 2) & (letters % 4 + counted >= 4), letters)
        return F.struct(
            letters.alias("letters"), counted.alias("pads"), F.coalesce(state["ended"], ended).alias("ended")
        )

    seen = F.aggregate(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), start, step)
    letters = F.replace(kept, F.lit("="), F.lit(""))
    data = F.when(seen["ended"].isNotNull(), F.substring(letters, F.lit(1), seen["ended"])).when(
        F.length(letters) % 4 == 0, letters
    )
    padded = F.concat(data, F.repeat(F.lit("="), F.pmod(-F.length(data), F.lit(4))))
    return F.when(encoded.rlike(r"\A[\x00-\x7F]*\z"), F.try_to_binary(padded, F.lit("base64")))


def decode_queries(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Tell text from image queries; adds ``kind``, ``mime_type`` and ``image``.

    An image query is a data address whose payload decodes; anything else is searched as text.
    """
    query = F.col(query_col)
    comma = F.instr(query, ",")
    header = F.substring_index(query, ",", 1)
    payload = F.substring(query, comma + 1, F.length(query))
    image = F.when(query.startswith("data:image/") & (comma > 0), _base64_bytes(payload))
    mime = F.get(F.split(F.substring_index(header, ";", 1), ":"), F.lit(1))
    return (
        queries.withColumn("image", image)
        .withColumn("kind", F.when(F.col("image").isNotNull(), F.lit("image")).otherwise(F.lit("text")))
        .withColumn("mime_type", F.when(F.col("image").isNotNull(), mime))
    )
