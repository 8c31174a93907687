"""Outlier flags, pattern flags and multi-rule validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import c, require
from ..functions.text import as_double, as_text, full_match
from .quantiles import exact_quantiles

# Named patterns of the validator.
PRESETS = {
    "account_no": r"[A-Za-z0-9\-]{6,18}",
    "id_generic": r"[A-Za-z0-9]{6,20}",
    "iban": r"[A-Z]{2}\d{2}[A-Z0-9]{1,30}",
}

FAILING_SAMPLES = 10


def outlier_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """One row per column: the bounds outside which a value is an outlier."""
    names = require(df, columns)
    numbers = df.select(*[as_double(df, name).alias(f"n{i}") for i, name in enumerate(names)])
    long = numbers.unpivot([], [f"n{i}" for i in range(len(names))], "name", "value")
    quartiles = exact_quantiles(long, ["name"], "value", [0.25, 0.75])
    reach = F.lit(float(k)) * (F.col("q1") - F.col("q0"))
    # Infinite quartiles can make a bound that is no number: then there is none on that side.
    low, high = F.col("q0") - reach, F.col("q1") + reach
    return quartiles.select(
        "name", F.when(~F.isnan(low), low).alias("low"), F.when(~F.isnan(high), high).alias("high")
    )


def detect_outliers(
    df: DataFrame, columns: Sequence[str], k: float = 1.5, prefix: str = "Outlier_"
) -> DataFrame:
    """Add ``Outlier_<column>``: outside the quartiles by more than ``k`` times their span.

    NULL and text that is no number are not outliers.
    """
    names = require(df, columns)
    if not names:
        return df
    # A scalar subquery: Spark runs it once and the flags compare against its values.
    bounds = (
        outlier_fences(df, names, k)
        .agg(
            F.struct(
                *[
                    F.max(F.when(F.col("name") == f"n{i}", F.col(side))).alias(f"{side}{i}")
                    for i in range(len(names))
                    for side in ("low", "high")
                ]
            ).alias("bounds")
        )
        .scalar()
    )
    marks = {}
    for i, name in enumerate(names):
        value = as_double(df, name)
        no = F.lit(False)
        outside = F.coalesce(value < bounds[f"low{i}"], no) | F.coalesce(value > bounds[f"high{i}"], no)
        marks[f"{prefix}{name}"] = F.coalesce(outside, F.lit(False))
    return df.withColumns(marks)


def validate_regex(
    df: DataFrame, column: str, pattern: str, dest: str | None = None
) -> DataFrame:
    """Add ``Valid_<column>``: True where the stripped text matches the whole pattern."""
    require(df, [column])
    return df.withColumn(dest or f"Valid_{column}", full_match(as_text(df, column), pattern))


def usable_rules(rules: Sequence[Mapping]) -> list[tuple[str, str]]:
    """(column, pattern) of every rule that names both; presets stand for patterns."""
    unknown = {rule["preset"] for rule in rules if rule.get("preset") and not rule.get("pattern")} - set(PRESETS)
    if unknown:
        raise ValueError(f"unknown presets {sorted(unknown)}; there are {sorted(PRESETS)}")
    named = [(rule.get("column"), rule.get("pattern") or PRESETS.get(rule.get("preset"))) for rule in rules]
    return [(column, pattern) for column, pattern in named if column and pattern]


def validate_rules(
    df: DataFrame, rules: Sequence[Mapping], samples: int = FAILING_SAMPLES
) -> DataFrame:
    """One row per rule: column, pattern, passed, failed and the first failing values.

    NULL counts as failed but is not sampled. Samples are the smallest failing texts, so
    that the answer does not depend on the order of the rows.
    """
    checks = usable_rules(rules)
    require(df, [column for column, _ in checks])
    if not checks:
        return df.sparkSession.createDataFrame(
            [], "column string, pattern string, passed bigint, failed bigint, samples array<string>"
        )
    checked = df.select(
        *[
            F.struct(
                as_text(df, column).alias("text"),
                full_match(as_text(df, column), pattern).alias("valid"),
            ).alias(f"r{i}")
            for i, (column, pattern) in enumerate(checks)
        ]
    )
    counts = checked.agg(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("rule"),
                    F.lit(column).alias("column"),
                    F.lit(pattern).alias("pattern"),
                    F.count_if(F.col(f"r{i}.valid")).alias("passed"),
                    F.count_if(~F.col(f"r{i}.valid")).alias("failed"),
                )
                for i, (column, pattern) in enumerate(checks)
            ]
        ).alias("rules")
    ).select(F.inline("rules"))
    # A rule is one group, yet the window's group limit lets a map task send at most
    # ``samples`` failing texts of it.
    best = Window.partitionBy("rule").orderBy("text")
    failing = (
        checked.unpivot([], checked.columns, "rule", "cell")
        .select(F.substring("rule", 2, 9).cast("int").alias("rule"), "cell.*")
        .filter(~F.col("valid") & F.col("text").isNotNull())
        .withColumn("__rn", F.row_number().over(best))
        .filter(F.col("__rn") <= samples)
        .groupBy("rule")
        .agg(F.sort_array(F.collect_list("text")).alias("samples"))
    )
    # Both sides have one row per rule.
    return (
        counts.join(F.broadcast(failing), "rule", "left")
        .orderBy("rule")
        .select(
            "column",
            "pattern",
            "passed",
            "failed",
            F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
        )
    )
