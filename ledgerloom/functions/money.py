"""Currency text to number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ws_trim


def currency_number(text: Column) -> Column:
    """``$1,200`` -> 1200.0, ``(1,200)`` -> -1200.0; text without a number -> NULL."""
    trimmed = ws_trim(text)
    number = F.regexp_replace(trimmed, r"[^0-9.\-]", "").try_cast("double")
    in_brackets = trimmed.startswith("(") & trimmed.endswith(")")
    return F.when(in_brackets, -number).otherwise(number)
