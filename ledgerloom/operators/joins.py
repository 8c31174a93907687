"""Joins on equal keys, key suggestions and join diagnostics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import c, drop_hidden, dtype, require, visible
from ..functions.text import ws_trim
from ..session import fits_broadcast

JOIN_TYPES = ("left", "right", "inner", "outer")
HOT_SHARES = 1000  # a key with more than one in so many rows is frequent; there are fewer than that
HOT_ROWS = 1_000_000  # and it has a thousandth of these rows at least
SALTS = 32  # tasks that the rows of a frequent key are dealt over
LONG_TEXT = 64  # longer texts are compared by digest


def _check_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    keys = require(left, keys)
    require(right, keys)
    if not keys:
        raise ValueError("a join needs a key present in both tables")
    for key in keys:
        a, b = dtype(left, key), dtype(right, key)
        if isinstance(a, T.StringType) != isinstance(b, T.StringType):
            raise ValueError(
                f"key {key!r} is {a.simpleString()} on the left and {b.simpleString()} on "
                "the right; cast one side first"
            )
    return keys


def join_tables(
    left: DataFrame,
    right: DataFrame,
    key: str | Sequence[str],
    how: str = "left",
    suffixes: Sequence[str] = ("_a", "_b"),
) -> DataFrame:
    """Join on equal keys (NULL equals NULL); the key appears once.

    Other columns both tables have get the suffixes. Where a side is small enough to be
    broadcast, Spark joins without a shuffle. Else AQE splits skewed partitions of the side that
    an outer join preserves, and keys frequent on its other side, found by a count of the keys, are
    joined apart with their rows dealt over SALTS tasks. A full outer join is a left join plus the
    right rows without a partner, found by their keys alone.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}, not {how!r}")
    right = drop_hidden(right)
    keys = _check_keys(left, right, [key] if isinstance(key, str) else key)
    return _join(left, right, keys, how, suffixes, left.select(*[c(k) for k in keys]))


def _join(left, right, keys, how, suffixes, left_keys, spread=True) -> DataFrame:
    """``left_keys`` holds the key values of ``left``, maybe from a cheaper source. Without ``spread`` no
    keys are counted, so both tables are used once."""
    left_name, right_name = _output_names(left, right, keys, suffixes)
    a = left.select(*[c(n).alias(left_name.get(n, n)) for n in left.columns])
    tokens = {k: f"__right_key{i}" for i, k in enumerate(keys)}
    b = right.select(*[c(n).alias(tokens.get(n) or right_name[n]) for n in right.columns])
    equal = reduce(and_, [c(k).eqNullSafe(F.col(t)) for k, t in tokens.items()])
    right_values = [c(right_name[n]) for n in right.columns if n not in tokens]

    def both(kind: str) -> DataFrame:
        # One of the two keys is NULL where a side has no partner.
        source = {k: F.col(t) if kind == "right" else c(k) for k, t in tokens.items()}
        return a.join(b, equal, kind).select(
            *[source[n].alias(n) if n in tokens else c(n) for n in a.columns], *right_values
        )

    def lone_left() -> DataFrame:
        return a.join(b.select(*tokens.values()).distinct(), equal, "left_anti")

    def lone_right() -> DataFrame:
        alone = b.join(left_keys.distinct(), equal, "left_anti")
        return alone.select(*[F.col(t).alias(k) for k, t in tokens.items()], *right_values)

    streams = left.isStreaming or right.isStreaming  # whose plan has no size to ask for
    small_a, small_b = (False, False) if streams else (fits_broadcast(a), fits_broadcast(b))
    shuffled = spread and not (small_a or small_b or streams)

    def preserved(kind: str) -> DataFrame:
        """A left or right join, safe against frequent keys on its other side."""
        if not shuffled:
            return both(kind)
        own, other = list(tokens), list(tokens.values())
        (outer, outer_keys), (inner, inner_keys) = ((a, own), (b, other)) if kind == "left" else ((b, other), (a, own))
        names = [f"__hot_key{i}" for i in range(len(own))]
        sizes = inner.groupBy(*[c(k).alias(n) for k, n in zip(inner_keys, names)]).agg(F.count("*").alias("__n"))
        least = F.greatest(sizes.agg(F.sum("__n")).scalar(), F.lit(HOT_ROWS))
        # Fewer than HOT_SHARES rows.
        hot = sizes.filter(F.col("__n") * HOT_SHARES > least).select(*names, F.lit(True).alias("__hot"))

        def marked(table, keys):
            same = reduce(and_, [c(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
            return table.join(F.broadcast(hot), same, "left").drop(*names)

        # Rows of a frequent key are dealt over salts on one side and copied to each on the other. Such
        # a key has partners, so a copy without one is no row of the result.
        copies = F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
        salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
        dealt = marked(inner, inner_keys).select(*[c(n) for n in inner.columns], salt.alias("__salt"), F.lit(True).alias("__met"))
        copied = marked(outer, outer_keys).withColumn("__copy", copies)
        met = copied.join(dealt, equal & (F.col("__copy") == F.col("__salt")), "left")
        whole = met.filter(F.col("__hot").isNull() | F.col("__met").isNotNull())
        key_of = {k: c(k) if kind == "left" else F.col(t) for k, t in tokens.items()}
        return whole.select(*[key_of[n].alias(n) if n in tokens else c(n) for n in a.columns], *right_values)

    if how in ("left", "right"):
        return preserved(how)
    if how != "outer" or left.isStreaming:
        return both(how)
    if small_a and not small_b:
        parts = [both("right"), lone_left()]
    else:
        parts = [preserved("left"), lone_right()]
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return whole.select(*[c(n) for n in both("inner").columns])


def _output_names(left, right, keys, suffixes):
    overlap = {n for n in right.columns if n not in keys} & set(left.columns)
    first, second = suffixes
    if overlap and first == second:
        raise ValueError(f"columns {sorted(overlap)} are in both tables; give two suffixes")
    left_name = {n: n + first for n in left.columns if n in overlap}
    right_name = {n: n + second if n in overlap else n for n in right.columns}
    output = [left_name.get(n, n) for n in left.columns]
    output += [right_name[n] for n in right.columns if n not in keys]
    if len(set(output)) < len(output):
        raise ValueError(f"suffixes {tuple(suffixes)} give the same name twice: {output}")
    return left_name, right_name


def join_on_common_columns(
    tables: Sequence[DataFrame],
    on: Sequence[str] | None = None,
    how: str = "outer",
    suffixes: Sequence[str] = ("_x", "_y"),
) -> DataFrame:
    """Join tables one after the other, by default on all columns that every one has.

    Keys are not counted beforehand, so each table is read once and a key frequent on the later
    side of an outer join stays in one partition: ``join_tables`` deals it over tasks.
    """
    if not tables:
        return SparkSession.active().createDataFrame([], T.StructType([]))
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}, not {how!r}")
    if on is None:
        on = sorted(set.intersection(*[set(visible(t)) for t in tables]))
    if not on:
        raise ValueError("the tables have no common column to join on")
    out, keys = drop_hidden(tables[0]), [c(k) for k in on]
    known = out.select(*keys)
    for table in map(drop_hidden, tables[1:]):
        out = _join(out, table, _check_keys(out, table, on), how, suffixes, known, spread=False)
        # In an outer join a key is known once any table has it. Taken from the tables,
        # the keys do not depend on the joins so far, which would run again for them.
        known = known.union(table.select(*keys)) if how == "outer" else out.select(*keys)
    return out


def _cells(df: DataFrame, names: Sequence[str], side: str) -> DataFrame:
    """(column, raw, value) rows of one side, counted; ``a`` and ``b`` tell the side."""
    narrow = df.select(*[c(n).cast("string").alias(n) for n in names])
    long = narrow.unpivot([], [c(n) for n in names], "column", "text")
    return long.select(
        "column",
        _short(F.col("text")).alias("raw"),
        _short(F.lower(ws_trim(F.col("text")))).alias("value"),
        F.lit(int(side == "a")).cast("bigint").alias("a"),
        F.lit(int(side == "b")).cast("bigint").alias("b"),
    )


def _short(text: Column) -> Column:
    """The text, or its digest, which no short text equals, where it is long: no texts are shuffled."""
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def suggest_join_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Score every common column as a join key, best first, ties by name.

    The score weighs the overlap of the trimmed, lower-cased values and how unique and
    how evenly unique the column is. All rows count, none are sampled. A frequent value
    is one row per map task after partial aggregation.
    """
    names = [n for n in visible(a) if n in visible(b)]
    schema = (
        "column string, score double, overlap double, left_uniqueness double, "
        "right_uniqueness double, left_only bigint, right_only bigint"
    )
    if not names:
        return a.sparkSession.createDataFrame([], schema)
    raw = (
        _cells(a, names, "a")
        .unionAll(_cells(b, names, "b"))
        .groupBy("column", "raw", "value")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    by_value = raw.groupBy("column", "value").agg(
        F.sum("a").alias("a"),
        F.sum("b").alias("b"),
        F.count_if(F.col("raw").isNotNull() & (F.col("a") > 0)).alias("raw_a"),
        F.count_if(F.col("raw").isNotNull() & (F.col("b") > 0)).alias("raw_b"),
    )
    real, in_a, in_b = F.col("value").isNotNull(), F.col("a") > 0, F.col("b") > 0
    by_column = by_value.groupBy("column").agg(
        F.sum("a").alias("rows_a"),
        F.sum("b").alias("rows_b"),
        F.sum("raw_a").alias("raw_a"),
        F.sum("raw_b").alias("raw_b"),
        F.count_if(real & in_a & in_b).alias("both"),
        F.count_if(real & in_a & ~in_b).alias("left_only"),
        F.count_if(real & in_b & ~in_a).alias("right_only"),
    )
    every = F.col("both") + F.col("left_only") + F.col("right_only")
    overlap = F.col("both") / F.greatest(every, F.lit(1))
    ua = F.col("raw_a") / F.greatest("rows_a", F.lit(1))
    ub = F.col("raw_b") / F.greatest("rows_b", F.lit(1))
    score = 0.5 * overlap + 0.25 * F.least(ua, ub) + 0.25 * (1 - F.abs(ua - ub))
    return by_column.select(
        "column",
        F.round(score, 4).alias("score"),
        F.round(overlap, 4).alias("overlap"),
        F.round(ua, 4).alias("left_uniqueness"),
        F.round(ub, 4).alias("right_uniqueness"),
        "left_only",
        "right_only",
    ).orderBy(F.desc("score"), "column")


def join_report(a: DataFrame, b: DataFrame, key: str, how: str = "left") -> DataFrame:
    """One row: rows the join would give, and rows of each side without a partner.

    Counted from the two key histograms, so the join itself, which a frequent key makes
    quadratic, never runs. Partners are looked up by the key's text.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"how must be one of {JOIN_TYPES}, not {how!r}")
    _check_keys(a, b, [key])

    def histogram(as_type: str | None) -> DataFrame:
        def side(df: DataFrame, mark: str) -> DataFrame:
            value = c(key).cast(as_type) if as_type else c(key)
            ones = [F.lit(int(mark == s)).cast("bigint").alias(s) for s in ("a", "b")]
            return df.select(value.alias("k"), *ones)

        return (
            side(a, "a")
            .unionAll(side(b, "b"))
            .groupBy("k")
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        )

    na, nb = F.col("a").cast("decimal(19,0)"), F.col("b").cast("decimal(19,0)")
    keep_a, keep_b = how in ("left", "outer"), how in ("right", "outer")
    produced = F.greatest(na, F.lit(int(keep_b))) * F.greatest(nb, F.lit(int(keep_a)))
    zero = F.lit(0).cast("decimal(38,0)")
    total = F.coalesce(F.sum(produced.cast("decimal(38,0)")), zero).alias("joined_count")
    lone = [
        F.coalesce(F.sum(F.when(F.col("b") == 0, F.col("a"))), F.lit(0)).alias("left_unmatched"),
        F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("b"))), F.lit(0)).alias("right_unmatched"),
    ]
    if dtype(a, key) == dtype(b, key):
        return histogram(None).agg(total, *lone)
    by_text = histogram("string").agg(F.struct(*lone)).scalar()
    return (
        histogram(None)
        .agg(total)
        .select("joined_count", by_text["left_unmatched"].alias("left_unmatched"),
                by_text["right_unmatched"].alias("right_unmatched"))
    )


def simulate_join(
    a: DataFrame, b: DataFrame, key: str, how: str = "left", sample: int = 10
) -> dict:
    """Columns, counts and a few rows of a join, for a look before it is added to a recipe."""
    joined = drop_hidden(join_tables(a, b, key, how))
    counts = join_report(a, b, key, how).first()
    return {
        "columns": joined.columns,
        "joined_count": int(counts["joined_count"]),
        "left_unmatched": int(counts["left_unmatched"]),
        "right_unmatched": int(counts["right_unmatched"]),
        "sample": [row.asDict() for row in joined.limit(int(sample or 10)).collect()],
    }
