"""Text steps, hand-computed."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom import (
    currency_to_float,
    lowercase_text,
    merge_columns,
    remove_symbols,
    replace_values,
    split_field,
    trim_whitespace,
)
from ledgerloom.functions.text import WHITESPACE, spark_pattern, spark_replacement


def column(df, name):
    return [row[name] for row in df.collect()]


def test_trim_takes_all_white_space_of_all_text_columns(table):
    df = table("a string, n int, b string", ("\t x y \n", 1, "　z"), (None, 2, ""))
    rows = [tuple(r) for r in trim_whitespace(df).collect()]
    assert rows == [("x y", 1, "z"), (None, 2, "")]
    assert column(trim_whitespace(df, ["b"]), "a") == ["\t x y \n", None]


def test_whitespace_is_what_python_strips():
    spaces = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(WHITESPACE) == spaces


def test_trim_without_text_columns_changes_nothing(table):
    assert column(trim_whitespace(table("n int", 1)), "n") == [1]


def test_lowercase_gives_text(table):
    df = lowercase_text(table("a string, n int", ("ÄB", 1), (None, 2)), ["a", "n"])
    assert column(df, "a") == ["äb", None]
    assert column(df, "n") == ["1", "2"]


def test_remove_symbols(table):
    df = table("a string", "a#b$ c_d-e.f/g", "é x", None)
    assert column(remove_symbols(df, ["a"]), "a") == ["ab c_d-e.f/g", " x", None]
    assert column(remove_symbols(df, ["a"], "a-c"), "a") == ["abc", "", None]


def test_replace_modes(table):
    df = table("a string, n int", ("view", 1), ("VIEW", 2), ("preview", None), (None, 1))
    assert column(replace_values(df, ["a"], "view", "x"), "a") == ["x", "VIEW", "preview", None]
    assert column(replace_values(df, ["a"], "view", "x", case_sensitive=False), "a") == [
        "x",
        "x",
        "preview",
        None,
    ]
    assert column(replace_values(df, ["a"], "v(i)", r"<\1>$", regex=True), "a") == [
        "<i>$ew",
        "VIEW",
        "pre<i>$ew",
        None,
    ]
    assert column(replace_values(df, ["n"], 1, 9), "n") == [9, 2, None, 9]
    assert column(replace_values(df, ["n"], "1", "one"), "n") == ["one", "2", None, "one"]
    assert column(replace_values(df, ["a"], 1, 9), "a") == ["view", "VIEW", "preview", None]
    assert column(replace_values(df, ["n"], None, 0), "n") == [1, 2, 0, 1]


def test_split(table):
    df = table("s string", "a--b-", "a", None, "a - b - c")
    three = split_field(df, "s", ["p", "q", "r"], "-")
    assert [tuple(r)[1:] for r in three.collect()] == [
        ("a", "", "b"),
        ("a", None, None),
        (None, None, None),
        ("a", "b", "c"),
    ]
    once = split_field(df, "s", ["p", "q"], "-", maxsplit=1)
    assert [tuple(r)[1:] for r in once.collect()][3] == ("a", "b - c")
    raw = split_field(df, "s", ["p"], "-", strip_parts=False)
    assert column(raw, "p")[3] == "a "


def test_merge_skips_empty_parts(table):
    df = table(
        "a string, n int, b string",
        ("x", 1, "y"),
        ("", None, "nan"),
        (None, 2, " z "),
    )
    merged = merge_columns(df, ["a", "n", "b"], "m", "-")
    assert column(merged, "m") == ["x-1-y", None, "2- z"]
    assert merge_columns(df, ["a", "b"], "m", drop_source=True).columns == ["n", "m"]
    assert merge_columns(df, ["a", "b"], "a", drop_source=True).columns == ["a", "n"]


def test_currency(table):
    texts = ["$1,200", "(1,200)", "", "-", "1-2", "(-5)", "₹99.50", None, " 7 ", "()", "1.2.3", "."]
    want = [1200.0, -1200.0, None, None, None, 5.0, 99.5, None, 7.0, None, None, None]
    df = currency_to_float(table("a string", *texts), ["a"])
    assert column(df, "a") == want
    assert column(currency_to_float(table("a bigint", 10**16, None), ["a"]), "a") == [1e16, None]


def _reference_amount(text):
    text = text.strip()
    sign, body = (-1, text[1:-1]) if text[:1] == "(" and text[-1:] == ")" else (1, text)
    body = re.sub(r"[^0-9.\-]", "", body)
    try:
        return sign * float(body)
    except ValueError:
        return None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="$€(),.- 0123456789a\t", max_size=12), min_size=50, max_size=80))
def test_currency_on_random_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    got = {r["i"]: r["a"] for r in currency_to_float(df, ["a"]).collect()}
    for i, text in enumerate(texts):
        want = _reference_amount(text)
        assert got[i] == want or (want is not None and math.isclose(got[i], want)), text


@pytest.mark.parametrize(
    "pattern, hit, miss",
    [
        (r"(?P<a_b>x)(?P=a_b)", "xx", "xy"),
        (r"[[x]+", "[x", "y"),
        (r"[]x]", "]", "y"),
        (r"[^]x]", "y", "]"),
        (r"a{,2}b", "aab", "aaab"),
        (r"a{b", "a{b", "ab"),
        (r"[a&&b]+", "a&b", "c"),
        (r"\d+\Z", "١٢", "x"),
        (r"(?i)abc", "ABC", "x"),
    ],
)
def test_python_patterns_run_on_spark(spark, pattern, hit, miss):
    assert re.fullmatch(pattern, hit) and not re.fullmatch(pattern, miss)
    from ledgerloom import validate_regex

    df = spark.createDataFrame([(hit,), (miss,)], "a string")
    assert column(validate_regex(df, "a", pattern), "Valid_a") == [True, False]


def test_bad_pattern_is_refused():
    with pytest.raises(ValueError):
        spark_pattern("(")


def test_replacement_text():
    assert spark_replacement(r"\1-\g<2>0 $ \g<na_me> \\") == "$1-$2\\0 \\$ ${na0me} \\\\"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=8), min_size=30, max_size=50))
def test_text_steps_are_idempotent(spark, texts):
    texts = [t.replace("\x00", "") for t in texts if not any(0xD800 <= ord(ch) < 0xE000 for ch in t)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, a string")
    once = trim_whitespace(df)
    assert {r["i"]: r["a"] for r in once.collect()} == {i: t.strip() for i, t in enumerate(texts)}
    assert sorted(column(trim_whitespace(once), "a")) == sorted(column(once, "a"))
