"""Group and aggregate with a ``{column: function(s)}`` specification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c, dtype, require
from ..functions.ordering import RowOrder, row_order
from ..functions.text import as_double, as_number
from .quantiles import exact_quantiles


def _present(df: DataFrame, name: str) -> Column:
    """The cell with NaN as NULL."""
    kind = dtype(df, name)
    return as_number(df, name) if isinstance(kind, (T.DoubleType, T.FloatType)) else c(name)


def _truth(df: DataFrame, name: str) -> Column:
    if isinstance(dtype(df, name), T.StringType):
        return c(name) != ""
    return _present(df, name).cast("boolean")


def adjusted_skewness(x: Column) -> Column:
    """Sample skewness with the usual small-sample factor; a constant has 0."""
    n = F.count(x).cast("double")
    factor = F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.coalesce(F.skewness(x) * factor, F.lit(0.0)))


BUILT_IN = {
    "sum": lambda df, n: F.coalesce(F.sum(as_number(df, n)), F.lit(0)),
    "mean": lambda df, n: F.avg(as_number(df, n)),
    "min": lambda df, n: F.min(_present(df, n)),
    "max": lambda df, n: F.max(_present(df, n)),
    "count": lambda df, n: F.count(_present(df, n)),
    "nunique": lambda df, n: F.count_distinct(_present(df, n)),
    "std": lambda df, n: F.stddev_samp(as_double(df, n)),
    "var": lambda df, n: F.var_samp(as_double(df, n)),
    "sem": lambda df, n: F.stddev_samp(as_double(df, n)) / F.sqrt(F.count(as_double(df, n))),
    "skew": lambda df, n: adjusted_skewness(as_double(df, n)),
    "prod": lambda df, n: F.coalesce(F.product(as_double(df, n)), F.lit(1.0)),
    "size": lambda df, n: F.count("*"),
    "any": lambda df, n: F.coalesce(F.bool_or(_truth(df, n)), F.lit(False)),
    "all": lambda df, n: F.coalesce(F.bool_and(_truth(df, n)), F.lit(True)),
}
ORDERED = ("first", "last")
AGGREGATES = (*BUILT_IN, *ORDERED, "median")


def group_by_aggregate(
    df: DataFrame,
    by: Sequence[str],
    aggs: Mapping[str, str | Sequence[str]],
    dropna: bool = False,
    order_by: Sequence[str] | RowOrder | None = None,
) -> DataFrame:
    """Aggregate per group. ``{col: fn}`` keeps the name, ``{col: [fn, ...]}`` gives ``col_fn``.

    NULL keys form a group unless ``dropna``. Every function combines partially before the
    shuffle, so a key holding a large share of the rows costs its group one row per task.
    """
    by = require(df, [by] if isinstance(by, str) else by)
    require(df, aggs)
    if not by or not aggs:
        raise ValueError("group_by_aggregate needs group columns and aggregates")
    listed = any(not isinstance(fns, str) for fns in aggs.values())
    wanted = [
        (name, fn, f"{name}_{fn}" if listed else name)
        for name, fns in aggs.items()
        for fn in ([fns] if isinstance(fns, str) else fns)
    ]
    unknown = sorted({fn for _, fn, _ in wanted} - set(AGGREGATES))
    if unknown:
        raise ValueError(f"unknown aggregates {unknown}; known: {sorted(AGGREGATES)}")
    output = [*by, *[alias for _, _, alias in wanted]]
    if len(set(output)) < len(output):
        raise ValueError(f"result columns are not unique: {output}")
    if dropna:
        df = df.filter(reduce(and_, [c(k).isNotNull() for k in by]))

    columns = []
    for name, fn, alias in wanted:
        if fn in BUILT_IN:
            columns.append(BUILT_IN[fn](df, name).alias(alias))
        elif fn in ORDERED:
            order = row_order(df, order_by)
            columns.append(order.first(_present(df, name), last=fn == "last").alias(alias))
    medians = [(name, alias) for name, fn, alias in wanted if fn == "median"]
    keys = [c(k) for k in by]
    if not medians:
        return df.groupBy(*keys).agg(*columns)
    grouped = df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()
    return _with_medians(df, by, grouped, medians).select(*[c(name) for name in output])


def _with_medians(df, by, grouped, medians) -> DataFrame:
    groups = [f"__k{i}" for i in range(len(by))]
    values = [f"__m{i}" for i in range(len(medians))]
    narrow = df.select(
        *[c(k).alias(g) for k, g in zip(by, groups)],
        *[as_double(df, name).alias(v) for (name, _), v in zip(medians, values)],
    )
    long = narrow.unpivot(groups, values, "__which", "__value")
    halves = exact_quantiles(long, [*groups, "__which"], "__value", [0.5])
    wide = halves.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("__which") == v, F.col("q0"))).alias(alias)
            for (_, alias), v in zip(medians, values)
        ]
    )
    matches = reduce(and_, [c(k).eqNullSafe(F.col(g)) for k, g in zip(by, groups)])
    return grouped.join(wide, matches, "left")
