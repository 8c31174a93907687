"""Recipes: folding, order, failures, audit and suggestions."""

import json

import pytest

from ledgerloom import (
    dedup_steps,
    export_bundle,
    load_recipe,
    log_table,
    needs_order,
    propose_recipe,
    recommend,
    run_recipe,
    run_recipe_file,
    suggest,
)
from ledgerloom.plans.recipe import STEPS
from ledgerloom.plans.suggest import TITLE_STEPS

SMOKE = [
    {"id": "1", "type": "standardizeDate", "config": {"col": "Date"}},
    {"id": "2", "type": "calculateNetProfit"},
    {"id": "3", "type": "sortByDate", "config": {"col": "Date", "order": "asc"}},
]


def column(df, name):
    return [row[name] for row in df.collect()]


def step(kind, **config):
    return {"type": kind, "config": config}


def test_smoke_recipe(sales):
    out = run_recipe(sales.orderBy("Revenue", ascending=False), SMOKE).df
    assert column(out, "Net Profit") == [200.0 + 20 * i for i in range(10)]
    assert out.columns == [*sales.columns, "Net Profit"]


def test_filters(sales):
    recipe = [
        {"type": "filterDateRange", "config": {"from": "2025-01-08", "to": "2025-01-10"}},
        step("filterDebitCredit", include=["Debit"]),
        step("calculateNetProfit"),
    ]
    rows = run_recipe(sales, recipe).df.collect()
    assert [(str(r["Date"])[:10], r["Net Profit"]) for r in rows] == [("2025-01-09", 360.0)]


def test_formula_and_group(sales):
    recipe = [
        step("addColumnFormula", dest="MarginPct", expr="(`Revenue`-`COGS`)/`Revenue`*100"),
        step("groupByAggregate", by=["Type"], aggs={"Revenue": ["sum", "max"], "COGS": ["sum"]}),
    ]
    rows = sorted(tuple(r) for r in run_recipe(sales, recipe).df.collect())
    assert rows == [("Credit", 6250, 1450, 3500), ("Debit", 6000, 1400, 3400)]


def test_replace_and_lowercase(sales):
    recipe = [
        step("replaceValues", columns=["Type"], to="Debit", value="DR"),
        step("lowercaseText", columns=["Type"]),
    ]
    assert set(column(run_recipe(sales, recipe).df, "Type")) == {"dr", "credit"}


def test_join_and_sort(table):
    left = table("`Account No` int, Date string", (1, "2024-01-02"), (2, "2024-01-01"), (3, "2024-02-01"))
    right = table("`Account No` int, Flag string", (2, "Y"), (3, "N"))
    recipe = {
        "steps": [
            step("sortByDate"),
            step("joinWithFile", key="Account No", how="left", suffixes=["", "_j"]),
        ]
    }
    out = run_recipe(left, recipe, join_table=right).df
    assert column(out, "Flag") == ["Y", None, "N"]
    missing = run_recipe(left, recipe)
    assert "second table" in missing.log[1]["error"]


def test_bad_steps_change_nothing(sales):
    recipe = [
        step("explode everything"),
        step("filterExpr", expr="no such column > 1"),
        step("filterExpr", expr="nothing > 1"),
        step("sortByDate", col="Missing"),
        step("validateRegex", column="Type"),
        step("validateRegex", column="Type", pattern="("),
        step("detectOutliers", columns=["Missing"]),
        step("currencyToFloat", columns=["Revenue"]),
    ]
    result = run_recipe(sales, recipe)
    assert result.df.columns == sales.columns
    assert ["error" in e for e in result.log] == [False, *[True] * 6, False]
    assert column(result.df, "Revenue")[0] == 1000.0


def test_empty_recipe(sales):
    for empty in ([], None, {"recipe": []}):
        result = run_recipe(sales, empty)
        assert result.log == [] and result.df.columns == sales.columns


def test_sort_decides_which_duplicate_is_kept(table):
    df = table("k int, Date string, n int", (1, "b", 1), (1, "a", 2), (2, "c", 3), (1, "b", 4))
    keep = lambda order, which: [
        tuple(r)
        for r in run_recipe(
            df,
            [step("sortByDate", order=order), step("dropDuplicates", subset=["k"], keep=which)],
            order_by=["n"],
        ).df.collect()
    ]
    assert keep("asc", "first") == [(1, "a", 2), (2, "c", 3)]
    assert keep("asc", "last") == [(1, "b", 4), (2, "c", 3)]
    assert keep("desc", "first") == [(2, "c", 3), (1, "b", 1)]
    assert keep("desc", "last") == [(2, "c", 3), (1, "a", 2)]


def test_sort_uses_the_value_at_its_step(table):
    df = table("Date string, n int", ("2", 1), ("10", 2))
    recipe = [step("sortByDate"), step("addColumnFormula", dest="Date", expr="int(Date)")]
    assert column(run_recipe(df, recipe).df, "n") == [2, 1]


def test_order_names_survive_later_steps(table):
    df = table("k int, t string, v int", (1, "B", 1), (1, "a", 2))
    recipe = [
        step("lowercaseText", columns=["t"]),
        step("groupByAggregate", by=["k"], aggs={"v": ["first", "last"]}),
    ]
    out = run_recipe(df, recipe, order_by=["t"]).df.first()
    assert (out["v_first"], out["v_last"]) == (1, 2)  # "B" < "a" before the lowercase step


def test_order_sensitive_step_without_order_is_an_error(sales):
    result = run_recipe(sales, [step("dropDuplicates", subset=["Type"])])
    assert "order" in result.log[0]["error"]
    assert needs_order([step("dropDuplicates", subset=["Type"])])
    assert not needs_order([step("dropDuplicates", subset=["Type"], keep=False)])
    assert not needs_order([step("dropDuplicates")])
    assert needs_order([step("groupByAggregate", by=["a"], aggs={"b": "first"})])
    assert not needs_order([step("groupByAggregate", by=["a"], aggs={"b": ["sum"]})])


def test_preview_pages(sales):
    result = run_recipe(sales, [step("sortByDate", order="desc")])
    assert column(result.preview(3, 2), "Revenue") == [1350, 1300, 1250]
    assert column(result.preview(0, -5), "Revenue")[0] == 1450
    grouped = run_recipe(sales, [step("groupByAggregate", by=["Type"], aggs={"COGS": "sum"})])
    assert column(grouped.preview(1), "Type") == ["Credit"]
    with pytest.raises(ValueError):
        run_recipe(sales, []).preview()


def test_every_step_type_runs(sales, table):
    configs = {
        "trimWhitespace": {},
        "lowercaseText": {"columns": ["Type"]},
        "removeSymbols": {"columns": ["Type"]},
        "replaceValues": {"columns": ["Type"], "to": "x"},
        "splitCombinedField": {"source": "Date", "into": ["y", "m"], "delimiter": "-"},
        "mergeColumns": {"cols": ["Type", "Date"]},
        "currencyToFloat": {"columns": ["Revenue"]},
        "standardizeDate": {},
        "filterDateRange": {},
        "sortByDate": {},
        "flagWeekend": {},
        "calculateGrossProfit": {},
        "calculateNetProfit": {},
        "aggregatePLByPeriod": {},
        "flagHighValue": {},
        "flagNegativeProfit": {"col": "Revenue"},
        "filterExpr": {"expr": "Revenue > 0"},
        "filterDebitCredit": {"include": ["debit"]},
        "deleteBlankRows": {},
        "addColumnFormula": {"expr": "1"},
        "renameColumns": {"names": {"Type": "Kind"}},
        "groupByAggregate": {"by": ["Type"], "aggs": {"Revenue": "sum"}},
        "dropDuplicates": {},
        "joinWithFile": {"key": "Account No", "how": "outer"},
        "joinOnCommonColumns": {"on": ["Account No"]},
        "consolidateMonthEnd": {},
        "detectOutliers": {"columns": ["Revenue"]},
        "validateRegex": {"column": "Type", "pattern": "D.*"},
    }
    assert set(configs) == set(STEPS)
    other = table("`Account No` string, Name string", ("ACC0001", "Acme"), ("ACC9999", "None"))
    for kind, config in configs.items():
        result = run_recipe(sales, [step(kind, **config)], join_table=other)
        assert "error" not in result.log[0], (kind, result.log[0])
        assert result.df.count() > 0
        assert not [n for n in result.df.columns if n.startswith("__")]


def test_rename_of_the_type_column(table):
    df = table("kind string, n int", ("a", 1))
    out = run_recipe(df, [step("filterDebitCredit", col="kind", include=["A"])]).df
    assert out.columns == ["Type", "n"]
    both = table("kind string, Type string", ("a", "b"))
    assert "error" in run_recipe(both, [step("filterDebitCredit", col="kind")]).log[0]


def test_audit_modes(sales):
    recipe = [step("filterExpr", expr="Revenue > 1100"), step("bad"), step("filterExpr", expr="x")]
    off = run_recipe(sales, recipe).log
    assert (off[0]["rows_before"], off[0]["rows_after"]) == (None, None)
    counted = run_recipe(sales, recipe, audit="count").log
    assert [(e.get("rows_before"), e.get("rows_after")) for e in counted] == [
        (10, 7),
        (7, 7),
        (None, None),
    ]
    observed = run_recipe(sales, recipe, audit="observe")
    assert observed.df.count() == 7
    assert [(e.get("rows_before"), e.get("rows_after")) for e in observed.resolve_log()] == [
        (10, 7),
        (7, 7),
        (None, None),
    ]
    with pytest.raises(ValueError):
        run_recipe(sales, recipe, audit="guess")


def test_log_table(sales, spark):
    log = run_recipe(sales, SMOKE, context={"template_name": "smoke", "dataset_hash": "h"}).log
    rows = log_table(spark, log).collect()
    assert [r["type"] for r in rows] == [s["type"] for s in SMOKE]
    assert json.loads(rows[0]["config"]) == {"col": "Date"}
    assert {r["template_name"] for r in rows} == {"smoke"}
    assert rows[0]["spark_version"] and rows[0]["timestamp"]


def test_saved_recipe_on_files(spark, sales, tmp_path):
    template = {"name": "t", "schema_version": "1.0.0", "recipe": SMOKE, "saved_at": "now"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(template))
    assert load_recipe(str(path)) == SMOKE
    sales.write.parquet(str(tmp_path / "sales.parquet"))
    out = run_recipe_file(spark, str(path), str(tmp_path / "sales.parquet"))
    assert out.df.count() == 10
    first = [*SMOKE[:2], step("dropDuplicates", subset=["Type"], keep="last")]
    path.write_text(json.dumps(first))
    kept = run_recipe_file(spark, str(path), str(tmp_path / "sales.parquet")).df
    assert kept.count() == 2 and kept.columns == [*sales.columns, "Net Profit"]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_export(spark, sales, tmp_path, kind):
    result = run_recipe(sales, SMOKE)
    paths = export_bundle(result.df, str(tmp_path / kind), result.log, kind)
    assert set(paths) == {"data", "pl_summary", "transformation_log"}
    reader = spark.read.option("header", True)
    data = reader.format(kind).load(paths["data"])
    assert data.count() == 10
    summary = reader.format(kind).load(paths["pl_summary"]).collect()
    assert [float(r["Net Profit"]) for r in summary] == [2900.0]
    assert reader.format(kind).load(paths["transformation_log"]).count() == 3


def test_export_resolves_the_log(spark, sales, tmp_path):
    result = run_recipe(sales, SMOKE, audit="observe")
    paths = export_bundle(result.df, str(tmp_path / "out"), result.log, "csv")
    log = spark.read.option("header", True).option("escape", '"').csv(paths["transformation_log"])
    assert {(r["rows_before"], r["rows_after"]) for r in log.collect()} == {("10", "10")}


def test_text_with_line_breaks_leaves_the_summary_alone(spark, table, tmp_path):
    df = table("Date string, Note string, Revenue double", ("2025-01-01", "a\nb", 20.0), ("2025-01-02", "c", 10.0))
    df = run_recipe(df.selectExpr("*", "0D AS COGS"), [step("calculateNetProfit")]).df
    paths = export_bundle(df, str(tmp_path / "out"), kind="csv")
    summary = spark.read.option("header", True).csv(paths["pl_summary"]).collect()
    assert [float(r["Revenue"]) for r in summary] == [30.0]


def test_dedup_steps():
    steps = [step("a", x=1), {"type": "b"}, {"id": "2", "type": "a", "config": {"x": 1}}, step("b")]
    assert dedup_steps(steps) == [step("a", x=1), {"type": "b", "config": {}}]


def test_recommendations():
    assert recommend(["Order_ID", "Unit Price"]) == ["Financial P&L operations", "Pattern Validation"]
    assert recommend(["Date"]) == ["Standardize Date", "Sort by Date"]
    assert recommend(["name"]) == []


def test_suggestions(sales, table):
    titles = suggest(sales, [*SMOKE, SMOKE[0], step("filterExpr"), step("filterExpr")])
    assert titles == [
        "Standardize Date",
        "Sort by Date",
        "Financial P&L operations",
        "Pattern Validation",
        "Filter by Expression",
        "Monthly P&L",
        "Convert Currency to Number",
        "Detect Outliers",
        "Remove Duplicates",
        "Add Net Sales Column",
    ]
    assert suggest(table("name string", "x")) == []
    assert set(titles) - {"Filter by Expression"} <= set(TITLE_STEPS)


def test_proposal(table):
    df = table(
        "`Invoice No` string, `Invoice Date` string, Sales string, Cost string, "
        "Discount double, Qty int, `Unit Price` double",
        ("INV-0001", "2024-01-01", "$5", "1,000", 0.1, 2, 3.0),
        ("INV-0002", "2024-01-02", "$6", "1", 0.2, 3, 4.0),
    )
    found = propose_recipe(df)
    assert [(p["type"], p["confidence"]) for p in found] == [
        ("validateRegex", 1.0),
        ("standardizeDate", 0.95),
        ("sortByDate", 0.8),
        ("validateRegex", 1.0),
        ("calculateNetProfit", 1.0),
        ("currencyToFloat", 0.9),
        ("addColumnFormula", 0.85),
        ("aggregatePLByPeriod", 0.9),
        ("detectOutliers", 0.7),
        ("dropDuplicates", 0.8),
    ]
    assert found[5]["config"]["columns"] == ["Sales", "Cost", "Discount", "Unit Price"]
    assert found[8]["config"] == {"columns": ["Unit Price", "Qty"], "k": 1.5}


def test_own_rules_and_odd_names(table):
    from ledgerloom.plans.suggest import RULES, Rule, proposals

    df = table("`a.b date` string, `it's` string", ("2024-01-01", "AB-123456"))
    own = Rule("lowercaseText", "contains(name, 'it')", "0.5", {"columns": "array(column)"}, column=True)
    found = propose_recipe(df, [*RULES, own])
    assert [(p["type"], p["confidence"]) for p in found] == [
        ("standardizeDate", 0.95), ("sortByDate", 0.8), ("validateRegex", 1.0), ("validateRegex", 1.0), ("lowercaseText", 0.5)
    ]
    assert found[-1]["config"] == {"columns": ["it's"]} and found[2]["config"]["pattern"] == r"^[A-Za-z0-9\\-]{6,20}$"
    assert proposals(df, []).count() == 0 and propose_recipe(table("name string", "x")) == []
