"""Tags, display fallbacks, notes and short ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipatlas.functions.blanks import strip

# Shown labels and the column each one shows.
NOTE_LABELS = {
    "Justification": "editing_justification",
    "Camera": "visuals_camera",
    "Audio": "audio_cues",
    "Pacing": "pacing",
    "Idea": "repurposing_idea",
    "Notes": "edit_cut_notes",
}
# Texts shown for missing fields.
UNTITLED = "Untitled Scene"
NO_SUMMARY = "No summary available"


def nonempty(text: Column) -> Column:
    """True for text that is neither NULL nor ''. Blanks count as text."""
    return text.isNotNull() & (text != "")


def or_default(text: Column, default: str) -> Column:
    return F.when(nonempty(text), text).otherwise(F.lit(default))


def tags_split(tags: Column) -> Column:
    """Comma parts as they are; an empty array for NULL and ''."""
    return F.when(nonempty(tags), F.split(tags, ",")).otherwise(F.array().cast("array<string>"))


def tags_clean(tags: Column) -> Column:
    """Comma parts without surrounding blanks and without empty ones."""
    return F.filter(F.transform(tags_split(tags), strip), lambda t: t != "")


def scene_details() -> Column:
    """Map of label to note with the empty notes left out."""
    pairs = [c for label, name in NOTE_LABELS.items() for c in (F.lit(label), F.col(name))]
    return F.map_filter(F.create_map(*pairs), lambda _, note: nonempty(note))


def short_asset_id(text: Column) -> Column:
    """``ASSET-`` and the leading hex digits of a 32-bit rolling hash; ``Unknown`` for ''.

    The hash runs over UTF-16 units: four hex digits each in the big-endian encoding.
    """
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), 1)
    wrap = 1 << 32
    rolled = F.aggregate(
        units,
        F.lit(0).cast("bigint"),
        lambda h, unit: F.pmod(h * 31 + F.conv(unit, 16, 10).cast("bigint"), F.lit(wrap)),
    )
    magnitude = F.when(rolled >= wrap // 2, F.lit(wrap) - rolled).otherwise(rolled)
    return F.when(nonempty(text), F.concat(F.lit("ASSET-"), F.substring(F.hex(magnitude), 1, 6))).otherwise(
        F.lit("Unknown")
    )
