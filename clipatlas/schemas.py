"""Fixed schemas of the tables and documents."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the scene table, in table order.
SCENE_TEXT_COLUMNS = [
    "video_id",
    "source",
    "timestamp_start",
    "timestamp_end",
    "title",
    "category",
    "description",
    "editing_justification",
    "visuals_camera",
    "audio_cues",
    "pacing",
    "repurposing_idea",
    "edit_cut_notes",
    "summary",
    "tags",
]
SCENE_REQUIRED = ["video_id", "source", "timestamp_start", "timestamp_end"]

# The string fields of one scene in a model response.
RESPONSE_SCENE_FIELDS = [
    "title",
    "start_timestamp",
    "end_timestamp",
    "category",
    "description",
    "editing_justification",
    "visuals_camera",
    "audio_cues",
    "pacing",
    "repurposing_idea",
    "edit_cut_notes",
]

VECTOR = T.ArrayType(T.DoubleType(), containsNull=False)


def _struct(fields: dict[str, T.DataType], required: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, n not in required) for n, t in fields.items()])


SCENES = _struct(
    {**{c: T.StringType() for c in SCENE_TEXT_COLUMNS}, "embedding": VECTOR},
    required=SCENE_REQUIRED,
)

PROMPTS = _struct(
    {
        "id": T.StringType(),
        "gcs_video_path": T.StringType(),
        "prompt_text": T.StringType(),
        "video_embedding": VECTOR,
        "prompt_embedding": VECTOR,
        "created_at": T.TimestampType(),
    },
    required=["id", "gcs_video_path", "prompt_text"],
)

# The text of an arriving record that is no JSON object; NULL for the others.
BROKEN_RECORD = "broken_record"

# One arriving model response: which video it is about, and the JSON text.
RESPONSE_RECORD = T.StructType(
    [
        T.StructField("response_id", T.StringType()),
        T.StructField("video_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField(BROKEN_RECORD, T.StringType()),
    ]
)
