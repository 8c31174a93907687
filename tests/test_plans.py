"""Physical plans: what is pushed down, what is shuffled, what is never there."""

import pytest

from ledgerloom import (
    detect_outliers,
    drop_duplicates,
    filter_date_range,
    group_by_aggregate,
    join_on_common_columns,
    join_tables,
    pl_by_period,
    preview,
    profile,
    run_recipe,
)
from ledgerloom.operators import quantiles
from ledgerloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def t(spark, data):
    return catalog.Tables(spark, data)


BATCH = sorted(
    set(catalog.QUERIES)
    - {"csv_round_trip", "csv_round_trip_documents", "json_round_trip", "export_summary"}
    - {"export_summary_csv", "stream_pl_by_month", "stream_recipe"}
)


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_join(spark, data, name):
    text = plan(catalog.QUERIES[name](spark, data))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct"):
        assert operator not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_date_filter_and_columns_reach_the_scan(t):
    text = plan(filter_date_range(t.orders, "o_orderdate", "1996-01-01").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text


def test_flagship_prunes_and_pushes(t):
    text = plan(run_recipe(t.lineitem, catalog.FLAGSHIP).df)
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual" in text
    assert "l_partkey" not in text and text.count("Exchange") == 1


def test_periods_combine_before_the_shuffle(t):
    text = plan(pl_by_period(t.lineitem, "l_shipdate", "M", "l_extendedprice", "l_quantity", sort=False))
    assert "partial_sum" in text and text.count("Exchange") == 1


def test_keep_first_limits_groups_before_the_shuffle(t):
    text = plan(drop_duplicates(t.orders, ["o_custkey"], order_by=["o_orderkey"]))
    assert text.count("WindowGroupLimit") == 2


def test_keep_none_combines_before_the_shuffle(t):
    narrow = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    text = plan(drop_duplicates(narrow, ["o_custkey"], keep=False))
    assert "partial_count" in text and "SortAggregate" not in text


def test_joins_are_hash_joins_on_null_safe_keys(spark, t):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in ("left", "inner", "right", "outer"):
            a = t.customer.withColumnRenamed("c_custkey", "k")
            text = plan(join_tables(a, t.orders.withColumnRenamed("o_custkey", "k"), "k", how))
            assert "SortMergeJoin" in text and "FullOuter" not in text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_every_table_of_a_join_is_joined_once(spark, t, how):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for n in range(2, 7):
            tables = [spark.range(9).selectExpr("id AS k", f"id AS v{i}") for i in range(n)]
            text = plan(join_on_common_columns(tables, ["k"], how))
            # An outer join looks up the keys of all tables before it; no join is run again.
            lone = n - 1 if how == "outer" else 0
            assert text.count("SortMergeJoin") == n - 1 + lone
            known = n * (n - 1) // 2 + n - 1 if how == "outer" else 0
            assert text.count("Range (") <= n + known
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_preview_is_a_top_k(t):
    assert "TakeOrderedAndProject" in plan(preview(t.orders, 5, 5, ["o_orderkey"]))


def test_one_sort_for_a_recipe(t):
    recipe = [
        {"type": "sortByDate", "config": {"col": "o_orderdate"}},
        {"type": "sortByDate", "config": {"col": "o_orderdate", "order": "desc"}},
        {"type": "filterExpr", "config": {"expr": "o_totalprice > 5"}},
    ]
    text = plan(run_recipe(t.orders, recipe).df)
    assert text.count("Exchange rangepartitioning") == 1


def test_quantiles_never_collect_a_group(t, monkeypatch):
    monkeypatch.setattr(quantiles, "ONE_TASK", 10)
    df = group_by_aggregate(t.orders, ["o_orderstatus"], {"o_totalprice": "median"})
    assert "percentile" not in plan(df) and "partial_kll_sketch_agg_double" in plan(df)


def test_no_sketch_where_groups_fit_a_task(t):
    df = group_by_aggregate(t.orders, ["o_orderstatus"], {"o_totalprice": "median"})
    df.collect()
    assert "kll" not in plan(df).split("== Initial Plan ==")[0]


def test_profile_shares_one_histogram(t):
    df = profile(t.orders)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 2


def test_outlier_bounds_run_once(t):
    df = detect_outliers(t.orders, ["o_totalprice"])
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedSubquery" in plan(df) or final.count("Subquery") <= 2
