"""Quantiles, outliers, validation and profiles."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom import (
    currency_shares,
    detect_currency_columns,
    detect_outliers,
    exact_quantiles,
    hit_rates,
    outlier_fences,
    profile,
    validate_regex,
    validate_rules,
)
from ledgerloom.operators import quantiles


def column(df, name):
    return [row[name] for row in df.collect()]


def _check_quantiles(spark, frame, probs):
    missing = lambda x, kind: None if pd.isna(x) else kind(x)
    rows = [(missing(g, int), missing(v, float)) for g, v in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    want = frame.dropna(subset=["v"]).groupby("g", dropna=False)["v"]
    assert len(got) == want.ngroups
    for key, values in want:
        expected = np.quantile(values.to_numpy(dtype=float), probs)
        key = None if pd.isna(key) else key
        assert np.allclose(got[key], expected, rtol=1e-12, atol=1e-12), (key, got[key], expected)


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-5, 5))),
        min_size=1,
        max_size=60,
    )
)
def test_quantiles_of_small_groups(spark, pairs):
    frame = pd.DataFrame(pairs, columns=["g", "v"])
    if frame["v"].notna().any():
        _check_quantiles(spark, frame, [0.0, 0.25, 0.5, 0.75, 1.0])


def test_group_median_equals_percentile(spark, data):
    from pyspark.sql import functions as F

    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    got = quantiles.exact_quantiles(lines, ["l_suppkey"], "l_extendedprice", [0.5]).collect()
    want = lines.groupBy("l_suppkey").agg(F.percentile("l_extendedprice", 0.5).alias("q0")).collect()
    assert {r[0]: round(r[1], 6) for r in got} == {r[0]: round(r[1], 6) for r in want}


def test_infinite_values(table):
    from ledgerloom.operators.quality import detect_outliers

    inf = float("inf")
    df = table("g string, v double", *[("a", x) for x in (1.0, 2.0, inf)])
    assert quantiles.exact_quantiles(df, ["g"], "v", [0.5]).collect()[0]["q0"] == 2.0
    df = table("v double", 1.0, 2.0, 3.0, 4.0, inf)
    flags = {r["v"]: r["Outlier_v"] for r in detect_outliers(df, ["v"]).collect()}
    assert flags == {1.0: False, 2.0: False, 3.0: False, 4.0: False, inf: True}


def test_unknown_preset_is_an_error(table):
    from ledgerloom.operators.quality import validate_rules

    with pytest.raises(ValueError, match="unknown presets"):
        validate_rules(table("a string", "x"), [{"column": "a", "preset": "nothing"}])


def test_dot_stops_at_newline_only(table):
    from ledgerloom.operators.quality import validate_regex

    df = validate_regex(table("a string", "a\rb", "a\u0085b", "a\u2028b", "a\nb", "ab"), "a", "a.?b")
    assert {r["a"]: r["Valid_a"] for r in df.collect()} == {
        "a\rb": True, "a\u0085b": True, "a\u2028b": True, "a\nb": False, "ab": True
    }


@pytest.mark.parametrize("accuracy, one_task", [(100, 10), (2048, 10**6)])
@pytest.mark.parametrize("kind", ["spread", "ties", "heavy tail", "infinite", "huge"])
def test_quantiles_with_a_hot_group(spark, kind, accuracy, one_task, monkeypatch):
    """A third of the rows in one group; a coarse sketch and small tasks, so that cells are really cut."""
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "ONE_TASK", one_task)
    rng = np.random.default_rng(5)
    n = 60_000
    values = {
        "spread": rng.normal(size=n),
        "ties": rng.integers(0, 4, size=n).astype(float),
        "heavy tail": np.exp(rng.normal(size=n) * 8),
        "infinite": rng.choice([-np.inf, -1.0, 0.0, 3.0, np.inf], size=n),
        "huge": rng.choice([-1.7e308, -1.0, 2.0, 1.7e308], size=n),
    }[kind]
    groups = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 50, size=n))
    frame = pd.DataFrame({"g": groups, "v": values})
    probs = [0.5] if kind in ("infinite", "huge") else [0.75, 0.25, 0.5]
    _check_quantiles(spark, frame, probs)


@pytest.mark.parametrize("shares", [1, 20, 10**9])
def test_quantiles_whatever_counts_as_hot(spark, shares, monkeypatch):
    """No group, some groups, and all groups handled apart."""
    monkeypatch.setattr(quantiles, "HOT_SHARES", shares)
    monkeypatch.setattr(quantiles, "ONE_TASK", 1)
    frame = pd.DataFrame({"g": [0] * 50 + [1, 2, 2, None, None], "v": range(55)})
    _check_quantiles(spark, frame, [0.1, 0.5])


def test_cells_are_equally_deep(spark):
    """Half of the values in [0, 1) and half near 1e9: equal widths would put all into a few cells."""
    from pyspark.sql import functions as F

    df = spark.range(400_000).select(
        F.lit(1).alias("__g0"), F.when(F.col("id") % 2 == 0, F.rand(3)).otherwise(1e9 + F.rand(4)).alias("__v")
    )
    hot = df.groupBy("__g0").agg(F.count("*").alias("__n"))
    ends = [F.lit(x).cast("double").alias(n) for n, x in (("__low", "-inf"), ("__high", "inf"))]
    cells = hot.select("__g0", "__n", F.lit(0).cast("bigint").alias("__begin"), F.col("__n").alias("__rows"), *ends)
    shares = [p + step * quantiles.CELL for p in (0.25, 0.5) for step in range(-quantiles.CELLS, quantiles.CELLS + 1)]
    cut = quantiles._cut(df, cells, ["__g0"], shares)
    rows = [r["__rows"] for r in cut.orderBy("__begin").collect()]
    assert sum(rows) == 400_000
    mean = quantiles.CELL * 400_000
    around = [r for r in rows if r < 20 * mean]  # all but the three stretches between the ranks' surroundings
    assert len(around) >= 4 * quantiles.CELLS - 2 and max(around) <= 4 * sum(around) / len(around)
    assert quantiles.exact_quantiles(df, ["__g0"], "__v", [0.25]).first()["q0"] < 1


def test_outliers(table):
    df = table("a string, b double", ("1", 1.0), ("2", 2.0), ("3", 3.0), ("4", 4.0), ("100", None))
    out = detect_outliers(df, ["a", "b"])
    assert column(out, "Outlier_a") == [False, False, False, False, True]
    assert column(out, "Outlier_b") == [False] * 5
    assert detect_outliers(df, []).columns == df.columns
    none = detect_outliers(table("a double", None, None), ["a"], prefix="o_")
    assert column(none, "o_a") == [False, False]


def test_outlier_fences_equal_pandas(spark):
    dice = random.Random(1)
    values = [dice.lognormvariate(0, 1) for _ in range(5_001)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    low, high = outlier_fences(df, ["x"], 1.5).select("low", "high").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert math.isclose(low, q1 - 1.5 * (q3 - q1)) and math.isclose(high, q3 + 1.5 * (q3 - q1))


def test_pattern_flag(table):
    df = table("a string", " ABC-000001 ", "ABC-1", None, "", "xABC-000001")
    assert column(validate_regex(df, "a", r"[A-Z]{3}-\d{6}"), "Valid_a") == [
        True,
        False,
        False,
        False,
        False,
    ]
    assert column(validate_regex(df, "a", "a|ABC-1", "ok"), "ok") == [False, True, False, False, False]


def test_rules(table):
    df = table("a string, n int", *[(f"x{i:02d}", i) for i in range(15)], (None, None))
    out = validate_rules(
        df,
        [
            {"column": "a", "pattern": "x00"},
            {"column": "n", "pattern": r"\d+"},
            {"column": "a"},
            {"column": "a", "preset": "account_no"},
            {"pattern": "x"},
        ],
    ).collect()
    assert [(r["column"], r["passed"], r["failed"]) for r in out] == [
        ("a", 1, 15),
        ("n", 15, 1),
        ("a", 0, 16),
    ]
    assert out[0]["samples"] == [f"x{i:02d}" for i in range(1, 11)]
    assert out[1]["samples"] == []
    assert validate_rules(df, []).count() == 0
    assert [r["failed"] for r in validate_rules(df.limit(0), [{"column": "a", "pattern": "x"}]).collect()] == [0]


def test_hit_rates(table):
    df = table(
        "m string, i string, n bigint, x double",
        ("$5", "ABC-123", 123456, 1.5),
        ("1,234.50", "ab", 1, 2.5),
        ("(12 345)", None, None, None),
        ("1234", "ABCDEF", 1234567, 1e10),
    )
    rates = {r["column"]: (r["currency_rate"], r["id_rate"]) for r in hit_rates(df).collect()}
    assert rates == {"m": (0.75, 0.0), "i": (0.0, 0.5), "n": (0.0, 0.5), "x": (0.0, 0.0)}


def test_profile(table):
    long_a, long_b = "a" * 100, "$" + "b" * 300
    df = table(
        "s string, n bigint, flag boolean, `Due Date` string, t string",
        ("x", 1, True, "2024-01-01", long_b),
        ("x", 2, False, "2024-05-01", long_b),
        ("y", 9, None, "junk", long_a),
        (None, None, True, None, "short"),
    )
    got = {r["column"]: r for r in profile(df).collect()}
    assert list(got) == df.columns
    s, n, flag, due, t = got.values()
    assert (s["dtype"], s["rows"], s["nulls"], s["uniques"]) == ("string", 4, 1, 2)
    assert [tuple(v) for v in s["top"]] == [("x", 2), ("y", 1)]
    assert (n["min"], n["max"], n["nulls"]) == (1.0, 9.0, 1)
    assert math.isclose(n["skew"], pd.Series([1, 2, 9]).skew())
    assert (flag["min"], flag["max"]) == (0.0, 1.0)
    assert (due["first_date"], due["last_date"]) == (datetime(2024, 1, 1), datetime(2024, 5, 1))
    assert s["min"] is None and due["min"] is None
    # Long texts are counted by digest, but shown whole.
    assert [tuple(v) for v in t["top"]] == [(long_b, 2), (long_a, 1), ("short", 1)] or [
        tuple(v) for v in t["top"]
    ] == [(long_b, 2), ("short", 1), (long_a, 1)]
    assert (t["uniques"], t["currency_rate"]) == (3, 0.5)
    rates = {r["column"]: (r["currency_rate"], r["id_rate"]) for r in hit_rates(df).collect()}
    assert rates == {k: (v["currency_rate"], v["id_rate"]) for k, v in got.items()}


def test_profile_of_no_rows(table):
    got = profile(table("a string, n int", ("x", 1)).limit(0)).collect()
    assert [(r["rows"], r["uniques"], r["top"]) for r in got] == [(0, 0, []), (0, 0, [])]


def test_currency_columns(table):
    df = table("a string, b string", ("$1", "x$"), ("2", None), ("€3", "y"))
    shares = {r["column"]: r["share"] for r in currency_shares(df).collect()}
    assert math.isclose(shares["a"], 1 / 3) and shares["b"] == 0.5
    assert detect_currency_columns(df) == ["a", "b"]
    assert detect_currency_columns(table("a string", "1", "2")) == []


def test_top_long_texts_in_text_order(table):
    texts = [letter + "x" * 79 for letter in "ihgfedcba"]
    top = profile(table("t string", *texts)).first()["top"]
    assert [(r["value"][0], r["count"]) for r in top] == [(x, 1) for x in "abcde"]
    # Alike in the characters that are kept, so all are looked up; short ones in between.
    tails = ["y" * 70 + letter for letter in "fedcbag"] + ["y" * 64, "y" * 64, "y" * 70 + "g"]
    top = profile(table("t string", *tails)).first()["top"]
    assert [(r["value"][64:], r["count"]) for r in top] == [("", 2), ("y" * 6 + "g", 2)] + [("y" * 6 + x, 1) for x in "abc"]
