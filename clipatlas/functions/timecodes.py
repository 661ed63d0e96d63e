"""Scene times written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clipatlas.functions.blanks import BLANK, plain_digits

# Whole numbers may carry a sign, surrounding blanks and single underscores between digits, which may be
# those of any script.
_SHORT = r"^[0-9]{1,9}$"
_WHOLE = f"^[{BLANK}]*[+-]?[0-9](_?[0-9])*[{BLANK}]*$"
# What a decimal of Spark can hold: parts of thirty digits after any number of zeros, as seconds.
_PART, SECONDS = "decimal(30,0)", "decimal(38,0)"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_BLANK = r"^\s*$"


def _whole(part: Column) -> Column:
    plain = plain_digits(part)
    long = F.when(plain.rlike(_WHOLE), F.regexp_replace(plain, f"[{BLANK}_]", "").try_cast(_PART))
    return F.when(part.rlike(_SHORT), part.try_cast("int").cast(_PART)).otherwise(long)


def _number(part: Column) -> Column:
    return F.when(part.rlike(_BLANK), F.lit(0.0)).when(
        part.rlike(_NUMBER), F.regexp_replace(part, r"\s", "").try_cast("double")
    )


def timestamp_seconds(text: Column) -> Column:
    """Seconds of ``MM:SS``, ``HH:MM:SS`` or a bare number; 0 when missing or malformed.

    Any other number of parts counts its first part alone. The result is a decimal, so that long numbers
    and their sums fit.
    """
    parts = F.split(text, ":")
    first, second, third = (_whole(F.get(parts, F.lit(i))) for i in range(3))
    seconds = (
        F.when(F.size(parts) == 2, (first * 60 + second).cast(SECONDS))
        .when(F.size(parts) == 3, (first * 3600 + second * 60 + third).cast(SECONDS))
        .otherwise(first)
    )
    return F.coalesce(seconds, F.lit(0).cast(SECONDS))


def timestamp_seconds_lenient(text: Column) -> Column:
    """As ``timestamp_seconds`` with fractions and empty parts allowed, as a double.

    A part that is no decimal number makes a two- or three-part time NULL and a bare one 0.
    """
    parts = F.split(text, ":")
    first, second, third = (_number(F.get(parts, F.lit(i))) for i in range(3))
    return (
        F.when(text.isNull() | (text == ""), F.lit(0.0))
        .when(F.size(parts) == 2, first * 60 + second)
        .when(F.size(parts) == 3, first * 3600 + second * 60 + third)
        .otherwise(F.coalesce(first, F.lit(0.0)))
    )


def scene_duration(start: Column, end: Column) -> Column:
    """Length of a scene in seconds, never negative."""
    return F.greatest(F.lit(0).cast(SECONDS), (timestamp_seconds(end) - timestamp_seconds(start)).cast(SECONDS))


def format_duration(seconds: Column) -> Column:
    """``1h 2m 3s``, ``2m 3s`` or ``3s``; ``0s`` for 0 and NULL."""
    s = F.coalesce(seconds.try_cast("bigint"), F.lit(0).cast("bigint"))
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60

    def text(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(unit))

    return (
        F.when(hours > 0, F.concat_ws(" ", text(hours, "h"), text(minutes, "m"), text(rest, "s")))
        .when(minutes > 0, F.concat_ws(" ", text(minutes, "m"), text(rest, "s")))
        .otherwise(text(rest, "s"))
    )
