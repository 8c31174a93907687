"""Joins, unions, duplicates and groups."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import (
    consolidate_periods,
    drop_duplicates,
    group_by_aggregate,
    join_on_common_columns,
    join_report,
    join_tables,
    simulate_join,
    suggest_join_keys,
    union_identical,
)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def left(table):
    return table("k int, v string", (1, "a"), (1, "b"), (None, "n"), (3, "c"))


@pytest.fixture
def right(table):
    return table("k int, v string, w int", (1, "A", 10), (None, "N", 20), (4, "D", 30))


@pytest.fixture(params=["10MB", "-1"])
def broadcast_limit(request, spark):
    """Both ways a join can go: one side broadcast, and both shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", request.param)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_join_types(left, right, how, broadcast_limit):
    out = join_tables(left, right, "k", how)
    assert out.columns == ["k", "v_a", "v_b", "w"]
    both = [(1, "a", "A", 10), (1, "b", "A", 10), (None, "n", "N", 20)]
    only_left, only_right = [(3, "c", None, None)], [(4, None, "D", 30)]
    want = both + only_left * (how in ("left", "outer")) + only_right * (how in ("right", "outer"))
    assert rows(out) == sorted(want, key=repr)


def test_join_suffixes(left, right):
    assert join_tables(left, right, "k", "left", ["", "_j"]).columns == ["k", "v", "v_j", "w"]
    assert join_tables(left, right.drop("v"), "k", "left", ["", ""]).columns == ["k", "v", "w"]
    with pytest.raises(ValueError, match="suffixes"):
        join_tables(left, right, "k", "left", ["", ""])
    with pytest.raises(ValueError, match="twice"):
        join_tables(left, right.withColumnRenamed("w", "v_b"), "k")
    with pytest.raises(ValueError, match="how"):
        join_tables(left, right, "k", "cross")
    with pytest.raises(ValueError, match="not in the table"):
        join_tables(left, right, "w")


def test_join_refuses_text_against_number(left, table):
    with pytest.raises(ValueError, match="cast"):
        join_tables(left, table("k string", "1"), "k")


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_self_join(left, how, broadcast_limit):
    assert join_tables(left, left, "k", how).count() == 6


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_join_with_a_hot_key_on_the_other_side(spark, how, broadcast_limit):
    few = spark.range(10).selectExpr("id AS k", "'x' AS a")
    many = spark.range(30_000).selectExpr("IF(id % 3 = 0, 7, id + 5) AS k", "id AS n")
    want = few.toPandas().merge(many.toPandas(), on="k", how=how)
    got = join_tables(few, many, "k", how).toPandas()
    key = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).values.tolist()))
    assert [len(got), key(got[["a"]])] == [len(want), key(want[["a"]])]
    assert sorted(got["k"]) == sorted(want["k"])


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_rows_of_a_hot_key_are_dealt_over_tasks(spark, how, monkeypatch):
    """A third of the other side's rows on one key: no task holds them all, and none is lost."""
    from ledgerloom.operators import joins

    monkeypatch.setattr(joins, "HOT_ROWS", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        ids = spark.range(9000)
        k = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id"))
        many = ids.select(k.cast("bigint").alias("k"), F.col("id").alias("w"))
        few = spark.range(6100).select(F.when(F.col("id") < 6098, F.col("id")).alias("k"), (-F.col("id")).alias("v"))
        left, right = (many, few) if how == "right" else (few, many)
        out = join_tables(left, right, "k", how)
        per_task = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        kind = {"outer": "full"}.get(how, how)
        want = left.withColumnRenamed("k", "j").join(right, F.col("j").eqNullSafe(F.col("k")), kind)
        want = want.select(F.coalesce("j", "k").alias("k"), *[n for n in ("v", "w", "v") if n in out.columns][:2])
        assert rows(out.select("k", "v", "w")) == rows(want.select("k", "v", "w"))
        assert per_task.max() < 3000
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_key_suggestions_shuffle_no_long_texts(table):
    long = ["a" * 100, " A" + "a" * 99, "b" * 100, None]
    df = table("t string", *long)
    row = suggest_join_keys(df, table("t string", "a" * 100, "c" * 70)).first()
    assert (row["left_only"], row["right_only"], row["overlap"]) == (1, 1, round(1 / 3, 4))
    assert (row["left_uniqueness"], row["right_uniqueness"]) == (0.75, 1.0)
    text = suggest_join_keys(df, df)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not any("text#" in line for line in dealt) and "sha2" in text


def test_join_with_dotted_key(table):
    a = table("`a.k` int, x int", (1, 2))
    assert rows(join_tables(a, a, "a.k", "outer")) == [(1, 2, 2)]


def _merged(frames, how):
    out = frames[0]
    for other in frames[1:]:
        out = out.merge(other, on="k", how=how, suffixes=("_x", "_y"))
    return Counter(tuple(None if pd.isna(x) else x for x in r) for r in out.itertuples(index=False))


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_three_way_join_equals_pandas(spark, how, broadcast_limit):
    dice = random.Random(7)
    frames = [
        pd.DataFrame(
            {
                "k": pd.array([dice.choice([None, *range(6)]) for _ in range(12)], dtype="object"),
                "v": [f"{name}{i}" for i in range(12)],
            }
        )
        for name in "abc"
    ]
    tables = [
        spark.createDataFrame(list(f.itertuples(index=False, name=None)), "k int, v string")
        for f in frames
    ]
    got = join_on_common_columns(tables, ["k"], how)
    assert got.columns == ["k", "v_x", "v_y", "v"]
    assert Counter(tuple(r) for r in got.collect()) == _merged(frames, how)


def test_common_columns(table):
    a, b = table("x int, k int, y int", (1, 2, 3)), table("k int, x int, z int", (2, 1, 4))
    assert join_on_common_columns([a, b]).columns == ["x", "k", "y", "z"]
    with pytest.raises(ValueError):
        join_on_common_columns([a, table("q int", 1)])
    assert join_on_common_columns([]).columns == []


@pytest.mark.parametrize("how", ["left", "right", "inner", "outer"])
def test_join_report_counts_what_the_join_gives(left, right, how):
    report = join_report(left, right, "k", how).first()
    assert report["joined_count"] == join_tables(left, right, "k", how).count()
    assert (report["left_unmatched"], report["right_unmatched"]) == (1, 1)


def test_join_report_of_numbers_of_different_kinds(table):
    a, b = table("k int", 1, 2), table("k double", 1.0, 5.0)
    report = join_report(a, b, "k", "inner").first()
    # The values are equal, their texts 1 and 1.0 are not.
    assert tuple(report) == (1, 2, 2)


def test_join_report_with_a_frequent_key(spark):
    big = spark.range(200_000).selectExpr("IF(id % 3 = 0, 0, id) AS k")
    report = join_report(big, big, "k", "inner").first()
    hot = 66_667
    assert report["joined_count"] == hot**2 + 200_000 - hot


def test_simulation(left, right):
    out = simulate_join(left, right, "k", "left", 2)
    assert out["joined_count"] == 4 and len(out["sample"]) == 2
    assert out["columns"] == ["k", "v_a", "v_b", "w"]


def test_key_suggestions(table):
    a = table("id string, g int, only int", (" A1", 1, 1), ("b2 ", 1, 1), ("c3", 2, 1), (None, 2, 1))
    b = table("g int, id string", (1, "a1"), (3, "B2"), (3, "x"))
    out = [tuple(r) for r in suggest_join_keys(a, b).collect()]
    # id: 2 of 4 values shared, 3 of 4 and 3 of 3 rows distinct
    # g: 1 of 3 shared, 2 of 4 and 2 of 3 distinct
    assert out == [
        ("id", 0.625, 0.5, 0.75, 1.0, 1, 1),
        ("g", 0.5, 0.3333, 0.5, 0.6667, 1, 1),
    ]
    assert suggest_join_keys(a.select("only"), b).count() == 0


def test_unions(table):
    a, b = table("A int, `B ` int", (1, 2)), table("a int, b int", (3, 4))
    other = table("z int", 9)
    assert rows(union_identical({"x": a, "y": b})) == [(1, 2), (3, 4)]
    assert rows(union_identical({"o": other, "x": a})) == [(9,)]
    assert rows(union_identical({"o": other, "x": a, "y": b}, merge_identical=True)) == [
        (1, 2),
        (3, 4),
    ]
    with pytest.raises(ValueError):
        union_identical({})


def test_consolidation_sorts_and_fills(table):
    a = table("Date string, x int", ("2024-02-10", 1), ("bad", 2))
    b = table("y int, Date string", (3, "2024-01-20"), (4, "2024-02-01"))
    out = consolidate_periods([a, b], "Date").collect()
    assert [(r.x, r.y, r.Period and r.Period.month) for r in out] == [
        (None, 3, 1),
        (None, 4, 2),
        (1, None, 2),
        (2, None, None),
    ]
    assert "Period" not in consolidate_periods([a], "Date", add_period=False).columns


def test_duplicates(table):
    df = table(
        "k int, v string, t int", (1, "a", 1), (1, "b", 2), (None, "c", 3), (None, "d", 4), (2, "e", 5)
    )
    keep = lambda how: [r[1] for r in rows(drop_duplicates(df, ["k"], how, order_by=["t"]))]
    assert sorted(keep("first")) == ["a", "c", "e"]
    assert sorted(keep("last")) == ["b", "d", "e"]
    assert keep(False) == keep("False") == ["e"]
    assert drop_duplicates(df.union(df)).count() == 5
    assert drop_duplicates(df.union(df), keep="last").count() == 5
    assert drop_duplicates(df.union(df), keep=False).count() == 0
    with pytest.raises(ValueError, match="order"):
        drop_duplicates(df, ["k"])
    with pytest.raises(ValueError, match="keep"):
        drop_duplicates(df, ["k"], "newest")


def test_group_names_and_nulls(table):
    df = table("g string, x int, y double", ("a", 1, None), ("a", 3, float("nan")), (None, 5, 2.0))
    assert group_by_aggregate(df, ["g"], {"x": "sum"}).columns == ["g", "x"]
    out = group_by_aggregate(df, ["g"], {"x": ["sum", "max"], "y": "count"})
    assert out.columns == ["g", "x_sum", "x_max", "y_count"]
    assert rows(out) == [("a", 4, 3, 0), (None, 5, 5, 1)]
    assert group_by_aggregate(df, ["g"], {"x": "sum"}, dropna=True).count() == 1
    for bad in ({"x": "mode"}, {}, {"q": "sum"}):
        with pytest.raises(ValueError):
            group_by_aggregate(df, ["g"], bad)
    with pytest.raises(ValueError, match="unique"):
        group_by_aggregate(df, ["g"], {"g": "count"})
    with pytest.raises(ValueError):
        group_by_aggregate(df, [], {"x": "sum"})


def test_group_functions_equal_pandas(spark):
    dice = random.Random(3)
    frame = pd.DataFrame(
        {
            "g": [dice.choice("abc") for _ in range(60)],
            "x": [dice.choice([None, *[dice.gauss(0, 5) for _ in range(4)]]) for _ in range(60)],
            "t": range(60),
        }
    )
    names = ["sum", "mean", "min", "max", "count", "nunique", "std", "var", "median", "first"]
    names += ["last", "size", "prod", "sem", "skew"]
    want = frame.groupby("g")["x"].agg(names)
    rows_ = [tuple(None if pd.isna(x) else x for x in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows_, "g string, x double, t int")
    got = group_by_aggregate(df, ["g"], {"x": names}, order_by=["t"]).toPandas().set_index("g")
    for name in names:
        for key in want.index:
            a, b = got.loc[key, f"x_{name}"], want.loc[key, name]
            assert math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12), (name, key, a, b)


def test_all_null_groups(table):
    df = table("g int, x double, b boolean", (1, None, None), (2, 1.0, True))
    aggs = {"x": ["sum", "prod", "mean", "median", "skew"], "b": ["any", "all"]}
    by_group = {r["g"]: tuple(r)[1:] for r in group_by_aggregate(df, ["g"], aggs).collect()}
    assert by_group[1] == (0.0, 1.0, None, None, None, False, True)
    assert by_group[2] == (1.0, 1.0, 1.0, 1.0, None, True, True)


def test_only_medians(table):
    df = table("g int, x int", (1, 1), (1, 2), (None, 7))
    assert rows(group_by_aggregate(df, ["g"], {"x": "median"})) == [(1, 1.5), (None, 7.0)]
