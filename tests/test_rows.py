"""Filters, formulas, finance columns and flags."""

from datetime import datetime

import pytest

from ledgerloom import (
    add_formula,
    delete_blank_rows,
    filter_expr,
    filter_types,
    flag_high_value,
    flag_negative_profit,
    gross_profit,
    net_profit,
    pl_by_period,
    pl_summary,
    rename_columns,
)


def column(df, name):
    return [row[name] for row in df.collect()]


def test_filter_expression(sales):
    out = filter_expr(sales, "`Revenue` > 1000 and `Type`=='Debit'")
    assert column(out, "Revenue") == [1100, 1200, 1300, 1400]
    assert filter_expr(sales, '`Account No` = "ACC0003"').count() == 1
    with pytest.raises(ValueError):
        filter_expr(sales, "  ")


def test_formula_gives_null_not_errors(table):
    df = table("a int, b int, t string", (1, 0, "x"), (0, 0, "1"), (6, 3, "2"))
    out = add_formula(add_formula(df, "q", "a / b"), "n", "cast(t as int)")
    assert [(r.q, r.n) for r in out.collect()] == [(None, None), (None, 1), (2.0, 2)]
    assert df.sparkSession.conf.get("spark.sql.ansi.enabled") == "true"


def test_odd_column_names(table):
    df = table("`a.b` string, `Account No` int, `t``k` int", ("x", 1, 2))
    out = add_formula(df, "sum", "`Account No` + `t``k`")
    assert column(out, "sum") == [3]
    assert column(filter_types(df, "a.b", ["X"]), "a.b") == ["x"]
    assert delete_blank_rows(df, ["a.b"]).count() == 1
    assert column(net_profit(df, "Account No", "t`k"), "Net Profit") == [-1.0]
    assert rename_columns(df, {"a.b": "c"}).columns[0] == "c"


def test_types(table):
    df = table("Type string", " Debit ", "credit", None)
    assert filter_types(df, include=["DEBIT"]).count() == 1
    assert filter_types(df, include=[]).count() == 0
    assert filter_types(df).count() == 2


def test_blank_rows(table):
    df = table(
        "a string, x double", (None, None), ("  ", None), ("v", 1.0), (None, float("nan"))
    )
    assert column(delete_blank_rows(df), "a") == ["  ", "v"]
    assert column(delete_blank_rows(df, ["a"]), "a") == ["v"]
    assert column(delete_blank_rows(df, ["a", "x"]), "a") == ["v"]


def test_profit_columns(table):
    df = table("Revenue bigint, COGS bigint, Expenses bigint", (100, 40, 10), (200, 50, 20))
    assert column(net_profit(df), "Net Profit") == [50.0, 130.0]
    assert column(net_profit(df.drop("Expenses")), "Net Profit") == [60.0, 150.0]
    assert column(gross_profit(df), "Gross Profit") == [60.0, 150.0]
    text = table("Revenue string, COGS string", ("10", None), (" 1e1 ", "x"), ("1d", "-.5"))
    assert column(net_profit(text), "Net Profit") == [10.0, 10.0, 0.5]
    with pytest.raises(ValueError):
        net_profit(df.drop("COGS"))


def test_profit_by_period(table):
    df = table(
        "Date string, Revenue string, COGS double, Expenses int",
        ("2024-01-05", "10", 4.0, 1),
        ("2024-01-31 23:00:00", "5", float("nan"), None),
        ("2024-02-01", "x", None, None),
        ("never", "7", 1.0, 1),
    )
    rows = [tuple(r) for r in pl_by_period(df).collect()]
    assert rows == [
        (datetime(2024, 1, 1), 15.0, 4.0, 1, 11.0, 10.0),
        (datetime(2024, 2, 1), 0.0, 0.0, 0, 0.0, 0.0),
        (None, 7.0, 1.0, 1, 6.0, 5.0),
    ]
    assert pl_by_period(df).columns == [
        "Period",
        "Revenue",
        "COGS",
        "Expenses",
        "Gross Profit",
        "Net Profit",
    ]
    quarter = pl_by_period(df.drop("Expenses"), freq="Q").collect()
    assert [r["Net Profit"] for r in quarter] == [11.0, 6.0]
    with pytest.raises(ValueError):
        pl_by_period(df.drop("COGS"))


def test_summary_finds_its_columns(table):
    df = table("`Order Date` string, Sales double, Cost double", ("2024-01-05", 3.0, 1.0))
    summary = pl_summary(df)
    assert summary.columns == ["Period", "Revenue", "COGS", "Gross Profit", "Net Profit"]
    assert summary.first()["Net Profit"] == 2.0
    assert pl_summary(df.drop("Cost")) is None


def test_flags(table):
    df = table("a int, b double, s string", (1, 20000.0, "x"), (10001, None, "y"), (None, None, ""))
    assert column(flag_high_value(df), "High Value") == [True, True, False]
    assert column(flag_high_value(df, "a"), "High Value") == [False, True, False]
    assert column(flag_high_value(df.select("s")), "High Value") == [False] * 3
    losses = table("`Net Profit` double", -1.0, 0.0, None)
    assert column(flag_negative_profit(losses), "Negative Profit") == [True, False, False]


def test_sales_example(sales):
    assert column(net_profit(sales), "Net Profit") == [200.0 + 20 * i for i in range(10)]
