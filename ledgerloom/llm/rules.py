"""Quality rules and robust multivariate outliers, in built-in functions only.

Each document has a vector of transformed statistics. Per language and source, the minimum
covariance determinant is sought from several starts by concentration steps: centre and scatter of
the half of the rows nearest so far, distances from them, and again. The start that ends with the
smallest determinant wins, is scaled to a normal group's median distance, and is estimated once more
from the rows that it finds ordinary. Rows far from that centre in Mahalanobis distance are rejected.
A group is only ever seen through its sums and counts, so the order of rows does not matter.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, staged, table, text_of, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_GROUP = 200  # smaller groups are pooled: per language, then all together
STEPS = 4  # concentration steps
SHARE = 0.5  # of a group's rows in the concentrated subset
STARTS = (0.25, 0.5, 0.75)  # quantiles of each statistic where a search starts
ORDINARY = 0.975  # share of a normal group that shapes the last estimate
FLOORS = (0.3, 0.05, 0.02, 0.02, 0.05)  # least standard deviation of each statistic
# Texts are not normal, so the cut is no chi-squared quantile: whatever the distribution, at most 5 / CUT, 1.25 %, of
# rows lie beyond it by Chebyshev's inequality for 5 statistics.
CUT = 400.0
HOT = 1000  # groups with a thousandth of all rows, at most a thousand of them, are broadcast
FINE = 32  # distances are ranked in steps of the FINE-th root of two
KEYS = ["pool", "hot", "start"]


def base_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    One row per row of ``docs``; NULL and empty texts have zeros. Repeated windows of three words
    are found by sorting the windows' hashes with their places, so a text of n words takes n log n.
    """
    text = F.col("text")
    rows = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        words_of(text).alias("words"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "").alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("words") > 2,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - 3),
                lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0))
        .otherwise(_covered(F.col("windows")))
        .cast("long")
        .alias("n_repeat_words"),
    )


def _covered(windows: Column) -> Column:
    """Words lying in a window whose hash occurs more than once."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    hashes = lambda s, k: F.get(s, k)["h"]
    # A let-binding: transform over an array of one holds the sorted array without computing it twice.
    repeated = F.transform(
        F.array(placed),
        lambda s: F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, k: (x["h"] == F.coalesce(hashes(s, k - 1), F.bitwise_not(x["h"])))
                    | (x["h"] == F.coalesce(hashes(s, k + 1), F.bitwise_not(x["h"]))),
                ),
                lambda x: x["i"],
            )
        ),
    )
    total = F.transform(
        repeated,
        lambda p: F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct(
                (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")
            ),
            lambda a: a["n"],
        ),
    )
    return F.get(total, 0)


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / words),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def chi_squared(share: float, size: int) -> float:
    """Quantile of the chi-squared distribution with ``size`` degrees of freedom (Wilson and Hilferty)."""
    part = 2 / (9 * size)
    return size * (1 - part + NormalDist().inv_cdf(share) * part**0.5) ** 3


def _cells(rows: DataFrame, least: int) -> DataFrame:
    """Which pool each (lang, source) belongs to: itself, its language, or all. ``wide`` tells cells, ``hot``
    pools, that hold a thousandth of all rows or more."""
    sizes = staged(rows.groupBy("lang", "source").agg(F.count("*").alias("n")), "outlier-sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    langs = sizes.where(F.col("n") < least).groupBy(F.col("lang").alias("l")).agg(F.sum("n").alias("pooled"))
    pool = (
        F.when(F.col("n") >= least, F.to_json(F.struct("lang", "source")))
        .when(F.col("pooled") >= least, F.to_json(F.struct("lang")))
        .otherwise(F.lit("all"))
    )
    cells = sizes.join(langs, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("pool", pool)
    pools = cells.groupBy("pool").agg((F.sum("n") * HOT >= total).alias("hot"))
    return staged(
        cells.join(pools, "pool").select(
            F.col("lang").alias("l"), F.col("source").alias("s"), "pool", "hot", (F.col("n") * HOT >= total).alias("wide")
        ),
        "outlier-cells",
    )


def _pooled(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``pool`` and ``hot``. Wide cells are at most ``HOT`` and broadcast; the rest have few rows each."""
    match = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    wide = F.broadcast(cells.where("wide"))
    rest = rows.join(wide, match, "left_anti").join(cells.where("not wide"), match)
    return rows.join(wide, match).unionByName(rest).drop("l", "s", "wide")


def _of_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with its group's row. Hot pools are at most ``HOT`` and broadcast, so none is one task's work."""
    keys = [k for k in KEYS if k in rows.columns and k in groups.columns]
    hot = rows.where("hot").join(F.broadcast(groups.where("hot")), keys)
    return hot.unionByName(rows.where("not hot").join(groups.where("not hot"), keys))


def _scatter(rows: DataFrame, size: int) -> DataFrame:
    """Centre and covariance of each group's rows: ``c0…, s00…``."""
    moments = [F.avg(f"x{i}").alias(f"c{i}") for i in range(size)]
    moments += [F.covar_pop(f"x{i}", f"x{j}").alias(f"s{i}{j}") for i in range(size) for j in range(i + 1)]
    return rows.groupBy(*KEYS).agg(*moments)


def _factor(scatter: DataFrame, size: int, floors: tuple[float, ...]) -> DataFrame:
    """Adds l00, l10, … with L L' = covariance, its diagonal raised by the floors, and ``volume``, the
    logarithm of its determinant's root."""
    out = scatter
    for i in range(size):
        for j in range(i + 1):
            value = F.col(f"s{i}{j}")
            if i == j:
                value = value + F.lit(floors[i] ** 2)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The floors keep the pivots of an exact factorisation above their square.
            pivot = F.sqrt(F.greatest(value, F.lit(floors[i] ** 2))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", pivot)
    volume = sum((F.log(f"l{i}{i}") for i in range(size)), F.lit(0.0))
    factor = [f"l{i}{j}" for i in range(size) for j in range(i + 1)]
    return out.select(*KEYS, *[f"c{i}" for i in range(size)], *factor, volume.alias("volume"))


def _distance(rows: DataFrame, factors: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``start`` and ``d2``, the squared Mahalanobis distance from the group's centre, by forward
    substitution; one row per start that ``factors`` has."""
    out = _of_group(rows, factors)
    for i in range(size):
        value = F.col(f"x{i}") - F.col(f"c{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(size)), F.lit(0.0))
    return out.select(*dict.fromkeys([*rows.columns, *KEYS]), d2.alias("d2"))


def _bounds(near: DataFrame, share: float) -> DataFrame:
    """The distance below which ``share`` of a group lies, rounded up to a rank step: counts of whole numbers,
    at most a few thousand different ones a group, that merge alike in any order."""
    step = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(2.0**-40))) * FINE)
    ranked = near.groupBy(*KEYS).agg(F.percentile(step, share).alias("step"))
    return ranked.select(*KEYS, F.pow(F.lit(2.0), (F.floor("step") + 1) / FINE).alias("bound"))


def _scaled(x: DataFrame, factors: DataFrame, size: int) -> DataFrame:
    """Distances scaled down until half of each group lies within a normal group's median distance."""
    near = _distance(x, factors, size)
    median = chi_squared(0.5, size)
    bounds = staged(_bounds(near, 0.5), "outlier-median")
    return _of_group(near, bounds).withColumn("d2", F.col("d2") * median / F.greatest("bound", F.lit(median)))


def robust_distance(
    rows: DataFrame,
    vector: list[Column],
    floors: tuple[float, ...] = FLOORS,
    steps: int = STEPS,
    share: float = SHARE,
    least: int = MIN_GROUP,
) -> DataFrame:
    """Adds ``d2`` to ``rows`` (a written table with ``lang`` and ``source``).

    The searches start at the quantiles ``STARTS`` of each statistic, scaled by the quartile ranges, which
    are read to a quarter of a floor. Every step works on all rows; pools are split by partial aggregation
    only. Up to nearly half of a pool may lie anywhere without drawing the estimate. Rows at a bound exactly
    belong to the subset, so ties stay together. Distances shrink as the share of far rows grows, for the median
    is taken of all rows: to a half at a third of far rows, to a third at 44 %. NULL languages and sources are groups of their own. Without
    rows nothing is added or lost.
    """
    size = len(vector)
    x = rows.select("*", *[v.alias(f"x{i}") for i, v in enumerate(vector)])
    x = staged(_pooled(x, _cells(rows, least)), "outlier-rows")
    read = lambda i: F.round(F.col(f"x{i}") / (floors[i] / 4))
    quantiles = [F.percentile(read(i), [0.25, 0.75, *STARTS]).alias(f"q{i}") for i in range(size)]
    start = x.groupBy("pool", "hot").agg(*quantiles)
    start = start.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(len(STARTS) - 1))))
    value = lambda i, k: F.get(f"q{i}", k) * (floors[i] / 4)
    spread = lambda i: (value(i, F.lit(1)) - value(i, F.lit(0))) / F.lit(1.349)
    start = start.select(
        *KEYS,
        *[value(i, F.col("start") + 2).alias(f"c{i}") for i in range(size)],
        *[
            (F.pow(spread(i), 2) if i == j else F.lit(0.0)).alias(f"s{i}{j}")
            for i in range(size)
            for j in range(i + 1)
        ],
    )
    factors = staged(_factor(start, size, floors), "outlier-start")
    for step in range(steps):
        near = _distance(x, factors, size)
        subset = _of_group(near, _bounds(near, share)).where("d2 <= bound")
        factors = staged(_factor(_scatter(subset, size), size, floors), f"outlier-step{step}")
    best = factors.groupBy("pool").agg(F.min_by("start", F.struct(F.round("volume", 6), "start")).alias("start"))
    factors = staged(factors.join(best, ["pool", "start"]), "outlier-best")
    ordinary = _scaled(x, factors, size).where(F.col("d2") <= chi_squared(ORDINARY, size))
    factors = staged(_factor(_scatter(ordinary, size), size, floors), "outlier-last")
    return _scaled(x, factors, size).select(*rows.columns, "d2")


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The statistics with ``base_failed``, ``d2`` and ``kept``: one row per row of ``docs``.

    NULL and empty texts fail the base rules. Only rows that pass them shape the estimates, and are
    judged by distance. Other columns are ignored; an empty table gives an empty table.
    """
    repeated = F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    failed = (F.col("n_words") < MIN_WORDS) | repeated
    rows = staged(base_statistics(docs).withColumn("base_failed", failed), "statistics")
    passed = robust_distance(rows.where(~F.col("base_failed")), _vector())
    out = passed.withColumn("kept", F.col("d2") <= cut)
    rest = rows.where("base_failed").select("*", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept"))
    return out.unionByName(rest)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept d2".split()
    return judge(table(spark, folder, "documents")).select(*columns)
