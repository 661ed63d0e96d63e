"""What counts as a blank or a digit in text of any script."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that is white space or separates text, as the inside of a character class.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Decimal digits of all scripts but ASCII, by their value.
_DIGITS = {c: str(unicodedata.decimal(c)) for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.decimal(c, None) is not None}


def strip(text: Column) -> Column:
    """``text`` without blanks at both ends."""
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def plain_digits(text: Column) -> Column:
    """``text`` with the decimal digits of every script as 0 to 9."""
    plain = F.translate(text, "".join(_DIGITS), "".join(_DIGITS.values()))
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)
