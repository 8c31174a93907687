"""Text helpers: whitespace trim, text to number, Python patterns on Spark's regex engine."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import c, dtype

# Every character Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Fixed value: the number texts that count as numeric ("1d" or "1f" do not).
NUMBER_TEXT = r"(?i)\A[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity)\z"


def ws_trim(col: Column) -> Column:
    """Strip all leading and trailing white space (``F.trim`` strips spaces only)."""
    return F.btrim(col, F.lit(WHITESPACE))


def blank_to_null(col: Column) -> Column:
    return F.nullif(ws_trim(col), F.lit(""))


def as_text(df: DataFrame, name: str) -> Column:
    col = c(name)
    return col if isinstance(dtype(df, name), T.StringType) else col.cast("string")


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a number; text that is no number, and NaN, become NULL."""
    kind, col = dtype(df, name), c(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    if isinstance(kind, T.NumericType):
        return col
    if isinstance(kind, T.BooleanType):
        return col.cast("int")
    if isinstance(kind, T.StringType):
        text = ws_trim(col)
        return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    if isinstance(kind, T.NullType):
        return F.lit(None).cast("double")
    raise ValueError(f"column {name!r} of type {kind.simpleString()} is not numeric")


def as_double(df: DataFrame, name: str) -> Column:
    return as_number(df, name).cast("double")


def number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_double(df, name), F.lit(0.0))


def spark_pattern(pattern: str) -> str:
    """A Python regular expression, rewritten where Spark's engine reads it differently.

    Raises ``ValueError`` for a pattern Python itself refuses.
    """
    try:
        re.compile(pattern)
    except re.error as err:
        raise ValueError(f"bad pattern {pattern!r}: {err}") from err
    out, i, in_class = [], 0, False
    while i < len(pattern):
        two, rest = pattern[i : i + 2], pattern[i:]
        if two == "\\Z" and not in_class:
            out.append(r"\z")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        elif in_class:
            if two == "&&":
                out.append(r"&\&")
                i += 2
                continue
            in_class = two[0] != "]"
            out.append(r"\[" if two[0] == "[" else two[0])
            i += 1
        elif two[0] == "[":
            in_class = True
            lead = re.match(r"\[\^?\]?", rest).group()
            out.append(lead.replace("]", r"\]"))
            i += len(lead)
        elif named := re.match(r"\(\?P<(\w+)>", rest):
            out.append(f"(?<{_group_name(named[1])}>")
            i += named.end()
        elif named := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(rf"\k<{_group_name(named[1])}>")
            i += named.end()
        elif open_range := re.match(r"\{,(\d+)\}", rest):
            out.append(f"{{0,{open_range[1]}}}")
            i += open_range.end()
        elif two[0] == "{" and not re.match(r"\{\d+(,\d*)?\}", rest):
            out.append(r"\{")
            i += 1
        else:
            out.append(two[0])
            i += 1
    # Unicode classes as in Python; only \n ends a line for the dot and the anchors.
    flags = "d" if re.search(r"[.^$]", pattern) else ""
    flags += "U" if re.search(r"\\[wWdDsSbB]", pattern) else ""
    return (f"(?{flags})" if flags else "") + "".join(out)


def _group_name(name: str) -> str:
    return name.replace("_", "0")


def spark_replacement(text: str) -> str:
    r"""A Python replacement text (``\1``, ``\g<name>``) in Spark's ``$1`` form."""
    out, i = [], 0
    while i < len(text):
        rest = text[i:]
        if ref := re.match(r"\\(\d{1,2})|\\g<(\d+)>", rest):
            out.append("$" + (ref[1] or ref[2]))
            i += ref.end()
            if text[i : i + 1].isdigit():
                out.append("\\" + text[i])
                i += 1
        elif ref := re.match(r"\\g<(\w+)>", rest):
            out.append("${" + _group_name(ref[1]) + "}")
            i += ref.end()
        elif escape := re.match(r"\\([nrt\\])", rest):
            out.append({"n": "\n", "r": "\r", "t": "\t", "\\": r"\\"}[escape[1]])
            i += 2
        else:
            out.append("\\" + rest[0] if rest[0] in "$\\" else rest[0])
            i += 1
    return "".join(out)


def full_match(text: Column, pattern: str) -> Column:
    """True where the stripped text matches as a whole; NULL and mismatch are False."""
    flag, body = re.fullmatch(r"(\(\?[dU]+\))?(.*)", spark_pattern(pattern), re.DOTALL).groups("")
    return F.coalesce(ws_trim(text).rlike(rf"{flag}\A(?:{body})\z"), F.lit(False))
