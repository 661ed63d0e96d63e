"""Model responses: JSON documents turned into scene rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipatlas.schemas import RESPONSE_SCENE_FIELDS, SCENE_TEXT_COLUMNS

# Leaves are read as variants first, so that their JSON type can be checked: a plain string schema
# would take a number or an object for text.
_LOOSE = T.ArrayType(
    T.StructType(
        [
            T.StructField("summary", T.VariantType()),
            T.StructField("tags", T.ArrayType(T.VariantType())),
            T.StructField(
                "scenes",
                T.ArrayType(T.StructType([T.StructField(f, T.VariantType()) for f in RESPONSE_SCENE_FIELDS])),
            ),
            T.StructField("end_of_document", T.BooleanType()),
        ]
    )
)
_END = ',{"end_of_document":true}]'
_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _is_text(leaf: Column) -> Column:
    return F.coalesce(F.schema_of_variant(leaf) == "STRING", F.lit(False))


def parse_responses(documents: DataFrame, text_col: str = "response") -> DataFrame:
    """Decode each document and say whether it is valid as a whole.

    Adds ``valid`` and ``analysis`` (NULL when invalid). The text is parsed as the first element of
    an array with an end mark after it, since the JSON reader ignores what follows a document.
    """
    wrapped = F.from_json(F.concat(F.lit("["), F.col(text_col), F.lit(_END)), _LOOSE, _JSON_OPTIONS)
    parsed = documents.withColumn("_parsed", wrapped)
    complete = (F.size("_parsed") == 2) & F.col("_parsed")[1]["end_of_document"]
    doc = F.get("_parsed", F.lit(0))
    typed = (
        _is_text(doc["summary"])
        & F.forall(doc["tags"], _is_text)
        & F.forall(
            doc["scenes"],
            lambda scene: F.forall(F.array(*[scene[f] for f in RESPONSE_SCENE_FIELDS]), _is_text),
        )
    )
    valid = F.coalesce(F.when(complete, typed), F.lit(False))
    analysis = F.struct(
        doc["summary"].cast("string").alias("summary"),
        F.transform(doc["tags"], lambda t: t.cast("string")).alias("tags"),
        F.transform(
            doc["scenes"],
            lambda scene: F.struct(*[scene[f].cast("string").alias(f) for f in RESPONSE_SCENE_FIELDS]),
        ).alias("scenes"),
    )
    return (
        parsed.withColumn("valid", valid)
        .withColumn("analysis", F.when(F.col("valid"), analysis))
        .drop("_parsed")
    )


def to_scene_rows(valid: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per scene in document order, with the video-level summary and joined tags on each.

    Expects ``video_id``, ``source`` and ``analysis``; ``keep`` names further columns to carry.
    """
    exploded = valid.select(
        *keep,
        "video_id",
        "source",
        F.col("analysis.summary").alias("summary"),
        F.array_join("analysis.tags", ",").alias("tags"),
        F.posexplode("analysis.scenes").alias("position", "scene"),
    )
    renamed = {"timestamp_start": "start_timestamp", "timestamp_end": "end_timestamp"}
    own = {"video_id", "source", "summary", "tags"}
    return exploded.select(
        *keep,
        "position",
        *[
            F.col(c) if c in own else F.col("scene")[renamed.get(c, c)].alias(c)
            for c in SCENE_TEXT_COLUMNS
        ],
    )
