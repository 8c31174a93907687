"""Profit columns, profit and loss by period, and the row flags of the export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULTS
from ..functions.dates import parse_dates, period_start
from ..functions.names import c, dtype, require, visible
from ..functions.text import as_double, as_number, number_or_zero

# Lower-cased column names recognised for the summary of an export.
SUMMARY_REVENUE = ("revenue", "sales", "turnover")
SUMMARY_COGS = ("cogs", "cost", "cost of goods sold", "cost_of_goods_sold")
SUMMARY_EXPENSES = ("expenses",)

PERIOD = "Period"


def gross_profit(
    df: DataFrame,
    revenue: str | None = None,
    cogs: str | None = None,
    dest: str = "Gross Profit",
) -> DataFrame:
    """revenue - cogs; what is not a number counts as 0."""
    revenue, cogs = require(df, [revenue or DEFAULTS.revenue, cogs or DEFAULTS.cogs])
    return df.withColumn(dest, number_or_zero(df, revenue) - number_or_zero(df, cogs))


def net_profit(
    df: DataFrame,
    revenue: str | None = None,
    cogs: str | None = None,
    expenses: str | None = None,
    dest: str = "Net Profit",
) -> DataFrame:
    """revenue - cogs - expenses, or revenue - cogs where the table has no expenses."""
    revenue, cogs = require(df, [revenue or DEFAULTS.revenue, cogs or DEFAULTS.cogs])
    expenses = DEFAULTS.expenses if expenses is None else expenses
    profit = number_or_zero(df, revenue) - number_or_zero(df, cogs)
    if expenses in df.columns:
        profit = profit - number_or_zero(df, expenses)
    return df.withColumn(dest, profit)


def pl_by_period(
    df: DataFrame,
    date: str | None = None,
    freq: str = "M",
    revenue: str | None = None,
    cogs: str | None = None,
    expenses: str | None = None,
    sort: bool = True,
) -> DataFrame:
    """Sums and profits per calendar period; rows without a date form a last group.

    One aggregate with map-side partial sums: what is shuffled is one row per task and
    period, whatever the size of a period.
    """
    date = date or DEFAULTS.date
    revenue, cogs = revenue or DEFAULTS.revenue, cogs or DEFAULTS.cogs
    expenses = DEFAULTS.expenses if expenses is None else expenses
    amounts = [revenue, cogs] + ([expenses] if expenses in df.columns else [])
    require(df, [date, *amounts])
    if PERIOD in amounts:
        raise ValueError(f"an amount column cannot be named {PERIOD!r}")
    dated = parse_dates(df, [date]).withColumn(PERIOD, period_start(c(date), freq))
    out = sum_periods(dated, revenue, cogs, expenses)
    return out.orderBy(c(PERIOD).asc_nulls_last()) if sort else out


def sum_periods(df: DataFrame, revenue: str, cogs: str, expenses: str | None) -> DataFrame:
    """Sums and profits per value of the column ``Period``."""
    amounts = [revenue, cogs] + ([expenses] if expenses in df.columns else [])
    sums = df.groupBy(PERIOD).agg(
        *[F.coalesce(F.sum(as_number(df, a)), F.lit(0)).alias(a) for a in amounts]
    )
    return net_profit(gross_profit(sums, revenue, cogs), revenue, cogs, expenses)


def pl_summary(df: DataFrame) -> DataFrame | None:
    """Monthly profit and loss, if columns are named like revenue, cost and a date."""

    def named(options: tuple[str, ...]) -> str | None:
        return next((n for n in visible(df) if n.lower() in options), None)

    revenue, cogs = named(SUMMARY_REVENUE), named(SUMMARY_COGS)
    expenses = named(SUMMARY_EXPENSES)
    date = next((n for n in visible(df) if "date" in n.lower()), None)
    if not (revenue and cogs and date):
        return None
    columns = [
        c(date).alias(DEFAULTS.date),
        c(revenue).alias(DEFAULTS.revenue),
        c(cogs).alias(DEFAULTS.cogs),
    ]
    if expenses:
        columns.append(c(expenses).alias(DEFAULTS.expenses))
    return pl_by_period(df.select(*columns))


def flag_high_value(
    df: DataFrame,
    column: str | None = None,
    threshold: float = 10000.0,
    dest: str = "High Value",
) -> DataFrame:
    """Mark rows whose value, or whose largest numeric cell, exceeds the threshold."""
    if column and column in df.columns:
        amount = as_double(df, column)
    else:
        numeric = [n for n in visible(df) if isinstance(dtype(df, n), T.NumericType)]
        cells = [as_double(df, n) for n in numeric]
        amount = F.greatest(*cells) if len(cells) > 1 else (cells or [F.lit(None)])[0]
    return df.withColumn(dest, F.coalesce(amount > F.lit(float(threshold)), F.lit(False)))


def flag_negative_profit(
    df: DataFrame, column: str = "Net Profit", dest: str = "Negative Profit"
) -> DataFrame:
    require(df, [column])
    return df.withColumn(dest, F.coalesce(as_double(df, column) < 0, F.lit(False)))
