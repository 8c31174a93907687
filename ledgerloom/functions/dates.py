"""Text to timestamp without a time zone, and starts of calendar periods."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ansi import null_on_error
from .names import c, dtype, require
from .text import ws_trim

# Date layouts tried in this order after ISO 8601; the month comes first
# in numeric dates unless that is impossible.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]",
    "d/M/yyyy[ H:mm[:ss]]",
    "M-d-yyyy",
    "d-M-yyyy",
    "yyyy/M/d[ H:mm[:ss]]",
    "yyyyMMdd",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "MMM d, yyyy",
    "d MMMM yyyy",
    "MMMM d, yyyy",
)

# Period code -> unit of the calendar period.
PERIOD_UNITS = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "A": "year"}


# What the letters of a layout stand for in a date text.
LAYOUT_SHAPES = {
    "yyyy": r"\d{4}",
    "MMMM": r"[A-Za-z]+",
    "MMM": r"[A-Za-z]{3}",
    "MM": r"(?:0[1-9]|1[0-2])",
    "M": r"(?:0?[1-9]|1[0-2])",
    "dd": r"(?:0[1-9]|[12]\d|3[01])",
    "d": r"(?:0?[1-9]|[12]\d|3[01])",
    "HH": r"\d{2}",
    "H": r"\d{1,2}",
    "mm": r"\d{2}",
    "ss": r"\d{2}",
    "[": "(?:",
    "]": ")?",
}


def layout_shape(layout: str) -> str | None:
    """A pattern that texts of a date layout match, or None for letters not known here."""
    out = []
    for part in re.findall(r"([A-Za-z])(\1*)|(.)", layout, flags=re.DOTALL):
        token = part[0] + part[1] or part[2]
        if token in LAYOUT_SHAPES:
            out.append(LAYOUT_SHAPES[token])
        elif token.isalpha() or token == "'":
            return None
        else:
            out.append(re.escape(token))
    return r"\A" + "".join(out) + r"\z"


def _parsed(text: Column, layout: str) -> Column:
    # A failed parse costs an exception inside Spark, a failed match next to nothing.
    parsed, shape = F.to_timestamp_ntz(text, F.lit(layout)), layout_shape(layout)
    return parsed if shape is None else F.when(text.rlike(shape), parsed)


def swapped(layout: str) -> str:
    """The layout with day and month changed over."""
    return re.sub("d+|M+", lambda part: ("M" if part[0][0] == "d" else "d") * len(part[0]), layout)


def twin_layouts(formats: Sequence[str]) -> list[tuple[str, str]]:
    """Pairs of numeric layouts that read the same texts with day and month changed over."""
    pairs = []
    for at, layout in enumerate(formats):
        other = swapped(layout)
        if other != layout and "MMM" not in layout + other and other in formats[at + 1 :]:
            pairs.append((layout, other))
    return pairs


def _votes(df: DataFrame, texts: dict[str, str], pairs: Sequence[tuple[str, str]]) -> Column:
    """Struct of ``<token>_<pair>``: whether more of a column's texts fit the pair's second layout than its first.

    A subquery over the date columns alone that runs once; a task sends one row of counts.
    """
    fits = {token: ws_trim(c(name)) for token, name in texts.items()}

    def count(token: str, layout: str) -> Column:
        return F.count_if(fits[token].rlike(layout_shape(layout)))

    votes = [
        (count(token, second) > count(token, first)).alias(f"{token}_{i}")
        for token in texts
        for i, (first, second) in enumerate(pairs)
    ]
    return df.agg(F.struct(*votes).alias("votes")).scalar()


def parse_dates(
    df: DataFrame,
    names: Sequence[str],
    formats: Sequence[str] = DATE_FORMATS,
    dayfirst: bool | None = None,
) -> DataFrame:
    """Turn the named columns into ``timestamp_ntz``; text that is no date becomes NULL.

    Columns that already are dates stay as they are, so filters still reach the scan. Where
    texts can be read with the day or the month first, a column's texts vote: the layout that
    more of them fit reads all it can (at a tie the one that comes first in ``formats``), the
    other only the rest. ``dayfirst`` decides without a vote. A stream cannot vote.
    """
    wanted, texts = {}, {}
    for name in require(df, names):
        kind = dtype(df, name)
        if isinstance(kind, T.TimestampNTZType):
            continue
        if isinstance(kind, (T.DateType, T.TimestampType, T.NullType)):
            wanted[name] = c(name).cast("timestamp_ntz")
        elif isinstance(kind, T.StringType):
            texts[f"__date_text{len(texts)}"] = name
        else:
            raise ValueError(f"column {name!r} of type {kind.simpleString()} holds no dates")
    pairs = [pair for pair in twin_layouts(formats) if all(map(layout_shape, pair))] if texts else []
    votes = _votes(df, texts, pairs) if pairs and dayfirst is None and not df.isStreaming else None
    for token, name in texts.items():
        text = F.col(token)
        tried = {layout: _parsed(text, layout) for layout in formats}
        for i, (first, second) in enumerate(pairs):
            if votes is not None:
                turned = votes[f"{token}_{i}"]
            else:
                turned = F.lit(dayfirst is not None and (first.index("d") < first.index("M")) != dayfirst)
            one, other = tried[first], tried.pop(second)
            tried[first] = F.when(turned, F.coalesce(other, one)).otherwise(F.coalesce(one, other))
        wanted[name] = F.coalesce(text.try_cast("timestamp_ntz"), *tried.values())
    if not wanted:
        return df
    with null_on_error(df.sparkSession):
        # Trimmed once, in a projection of its own, not once per layout.
        trimmed = df.withColumns({token: ws_trim(c(name)) for token, name in texts.items()})
        return trimmed.withColumns(wanted).drop(*texts)


def timestamp_literal(value) -> Column:
    """A bound given as text, date or datetime, as a ``timestamp_ntz`` literal."""
    if not isinstance(value, datetime):
        text = str(value).strip()
        try:
            value = datetime.fromisoformat(text)
        except ValueError:
            for layout in ("%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d"):
                try:
                    value = datetime.strptime(text, layout)
                    break
                except ValueError:
                    continue
            else:
                raise ValueError(f"not a date: {text!r}") from None
    return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def period_start(ts: Column, freq: str) -> Column:
    """First instant of the period holding ``ts``, computed on dates (no time zone)."""
    unit = PERIOD_UNITS.get(str(freq).upper())
    if unit is None:
        raise ValueError(f"unknown period {freq!r}; use one of {sorted(PERIOD_UNITS)}")
    day = ts.cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")
