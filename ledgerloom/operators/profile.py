"""Column profile: nulls, distinct values, most frequent values, statistics, pattern rates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import parse_dates
from ..functions.names import c, drop_hidden, dtype, require, visible
from ..functions.text import as_double, as_text
from .aggregate import adjusted_skewness

# Texts that look like an amount (they hold a currency symbol, or are digits
# grouped in threes), and texts that look like an identifier. Symbols are looked for as plain
# text, which on long texts is much faster than as part of the pattern.
CURRENCY_SYMBOLS = ("$", "€", "£", "₹")
GROUPED_AMOUNT = r"^\(?-?\d{1,3}(?:[ ,]\d{3})+(?:\.\d+)?\)?$"
ID_HIT = r"^[A-Za-z0-9\-]{6,20}$"
CURRENCY_SHARE = 0.3

TOP_VALUES = 5
# Longer texts are grouped by their SHA-256 digest, so a profile of documents does not
# shuffle the documents; only those that may be among the most frequent are looked up again.
# As many characters of them are kept to order those of equal counts.
LONG_TEXT = 64

STATISTICS = ("min", "max", "skew", "first_date", "last_date")


def is_currency(text: Column) -> Column:
    symbol = reduce(or_, [F.contains(text, F.lit(symbol)) for symbol in CURRENCY_SYMBOLS])
    return symbol | text.rlike(GROUPED_AMOUNT)


def _hits(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(looks like currency, looks like an identifier); only text needs the patterns."""
    kind, text = dtype(df, name), as_text(df, name)
    if isinstance(kind, T.StringType):
        return is_currency(text), text.rlike(ID_HIT)
    if isinstance(kind, T.IntegralType):
        return F.lit(False), F.length(text).between(6, 20)
    if isinstance(kind, (T.FractionalType, T.BooleanType)):
        return F.lit(False), F.lit(False)
    return F.lit(False), text.rlike(ID_HIT)


def hit_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the share of rows that look like currency, and like an identifier.

    NULL is no hit and all rows count. One wide aggregate: one row per task is shuffled.
    """

    def rate(hit: Column) -> Column:
        return F.avg(F.when(hit, 1.0).otherwise(0.0))

    rows = []
    for name in require(df, columns or visible(df)):
        currency, identifier = _hits(df, name)
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                rate(currency).alias("currency_rate"),
                rate(identifier).alias("id_rate"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def _value_text(df: DataFrame, name: str) -> Column:
    """The value as text; NaN is NULL and both zeros are one."""
    if isinstance(dtype(df, name), (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c(name)), c(name) + F.lit(0.0).cast(dtype(df, name))).cast("string")
    return as_text(df, name)


def _histogram(df: DataFrame) -> DataFrame:
    """Rows (column, key, head, digest, currency, n): every value of every column, counted."""
    cells = df.select(*[_value_text(df, n).alias(n) for n in df.columns])
    long = cells.unpivot([], [c(n) for n in df.columns], "column", "value")
    value = F.col("value")
    is_long = F.coalesce(F.length(value) > LONG_TEXT, F.lit(False))
    return (
        long.select(
            "column",
            F.when(is_long, F.sha2(value, 256)).otherwise(value).alias("key"),
            F.when(is_long, F.substring(value, 1, LONG_TEXT)).alias("head"),
            is_long.alias("digest"),
            F.when(is_long, is_currency(value)).alias("currency"),
        )
        .groupBy("column", "key", "head", "digest", "currency")
        .agg(F.count("*").alias("n"))
    )


def _top_values(df: DataFrame, histogram: DataFrame) -> DataFrame:
    """(column, top): the most frequent values with counts, ties in text order."""
    # NULL is ranked last and dropped afterwards: a filter before would be pushed into the
    # scan, and the histogram's shuffle could not be shared with the counts. Ranks leave out
    # nothing that ties with the last place as far as the heads tell.
    best = Window.partitionBy("column").orderBy(F.isnull("key"), F.desc("n"), F.coalesce("head", "key"))
    top = (
        histogram.withColumn("rank", F.rank().over(best))
        .filter(F.col("rank") <= TOP_VALUES)
        .filter("key IS NOT NULL")
        .select("column", "key", "digest", "n")
    )
    shown = top.withColumn("value", F.col("key"))
    texts = [n for n in df.columns if isinstance(dtype(df, n), T.StringType)]
    if texts:
        # A few rows, unless very many texts have one head. Where no top value is a digest
        # the join has an empty side and AQE drops this second scan.
        wanted = top.filter("digest").select("column", "key")
        cells = df.select(*[c(n) for n in texts]).unpivot([], [c(n) for n in texts], "column", "text")
        whole = (
            cells.filter(F.length("text") > LONG_TEXT)
            .withColumn("key", F.sha2("text", 256))
            .join(wanted, ["column", "key"])
            .groupBy("column", "key")
            .agg(F.any_value("text").alias("text"))
        )
        shown = top.join(whole, ["column", "key"], "left").withColumn(
            "value", F.when(F.col("digest"), F.col("text")).otherwise(F.col("key"))
        )
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    shown = shown.withColumn("rank", place).filter(F.col("rank") <= TOP_VALUES)
    return shown.groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "value", "n"))),
            lambda row: F.struct(row["value"].alias("value"), row["n"].alias("count")),
        ).alias("top")
    )


def _is_date_name(df: DataFrame, name: str) -> bool:
    return "date" in name.lower() and not _is_numeric(df, name)


def _is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(dtype(df, name), (T.NumericType, T.BooleanType))


def _facts(df: DataFrame) -> DataFrame:
    """(position, column, dtype, statistics) of every column from one wide aggregate."""
    typed = parse_dates(df, [n for n in df.columns if _is_date_name(df, n)])
    number, day = F.lit(None).cast("double"), F.lit(None).cast("timestamp_ntz")
    rows = []
    for position, name in enumerate(df.columns):
        values = [number, number, number, day, day]
        if _is_numeric(df, name):
            x = as_double(df, name)
            values[:3] = F.min(x), F.max(x), F.coalesce(adjusted_skewness(x), F.lit(0.0))
        elif _is_date_name(df, name):
            values[3:] = F.min(c(name)), F.max(c(name))
        rows.append(
            F.struct(
                F.lit(position).alias("position"),
                F.lit(name).alias("column"),
                F.lit(dtype(df, name).simpleString()).alias("dtype"),
                *[v.alias(f) for v, f in zip(values, STATISTICS)],
            )
        )
    return typed.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column, in table order.

    ``column, dtype, rows, nulls, uniques, top, currency_rate, id_rate`` and, by kind,
    ``min, max, skew`` (numbers) or ``first_date, last_date`` (names holding "date").
    All columns share one histogram shuffle and one wide aggregate.
    """
    df = drop_hidden(df)
    histogram = _histogram(df)
    n, key = F.col("n"), F.col("key")
    # Numbers and flags never look like currency, see _hits; dates and integers may be ids.
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    plain = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.FractionalType, T.BooleanType))
    ]
    money = F.when(F.col("digest"), F.col("currency")).otherwise(
        F.col("column").isin(texts) & is_currency(key)
    )
    identifier = F.col("column").isin(plain) & ~F.col("digest") & key.rlike(ID_HIT)

    def share(hit: Column) -> Column:
        return F.sum(F.when(hit, n).otherwise(0)) / F.sum(n)

    counts = histogram.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(key.isNull(), n).otherwise(0)).alias("nulls"),
        F.count("key").alias("uniques"),
        share(money).alias("currency_rate"),
        share(identifier).alias("id_rate"),
    )
    zero = F.lit(0).cast("bigint")
    # All three sides have one row per column of the table.
    return (
        _facts(df)
        .join(F.broadcast(counts), "column", "left")
        .join(F.broadcast(_top_values(df, histogram)), "column", "left")
        .orderBy("position")
        .select(
            "column",
            "dtype",
            F.coalesce("rows", zero).alias("rows"),
            F.coalesce("nulls", zero).alias("nulls"),
            F.coalesce("uniques", zero).alias("uniques"),
            F.coalesce("top", F.array().cast("array<struct<value:string,count:bigint>>")).alias(
                "top"
            ),
            "currency_rate",
            "id_rate",
            *STATISTICS,
        )
    )


def currency_shares(df: DataFrame, rows: int | None = None) -> DataFrame:
    """(column, share): for each column the best share of non-null values with one symbol.

    All rows count unless ``rows`` limits the look to the head of the table.
    """
    names = visible(df)
    cells = df.select(*[as_text(df, n).alias(f"v{i}") for i, n in enumerate(names)])
    if rows is not None:
        cells = cells.limit(rows)

    def share(text: str) -> Column:
        # NULL holds nothing and is left out of the average.
        holds = [F.contains(text, F.lit(symbol)).cast("double") for symbol in CURRENCY_SYMBOLS]
        return F.greatest(*[F.avg(hit) for hit in holds])

    shares = [
        F.struct(F.lit(n).alias("column"), share(f"v{i}").alias("share"))
        for i, n in enumerate(names)
    ]
    return cells.agg(F.array(*shares).alias("rows")).select(F.inline("rows"))


def detect_currency_columns(df: DataFrame, rows: int | None = None) -> list[str]:
    """Columns where more than 0.3 of the values hold a currency symbol; ``rows`` looks at the head only."""
    found = currency_shares(df, rows).filter(F.col("share") > CURRENCY_SHARE).collect()
    hits = {row["column"] for row in found}
    return [name for name in visible(df) if name in hits]
