"""Readers, writers, previews and generated tables."""

import json
from datetime import datetime

import pytest

from ledgerloom import (
    describe,
    describe_tables,
    detect_format,
    drop_duplicates,
    preview,
    read_csv,
    read_json,
    read_table,
    sample_records,
    select_tables,
    write_csv,
    write_json,
)
from ledgerloom.functions.names import ROW_ID
from ledgerloom.sources.readers import SNIFF_CHARS, first_lines, sniff_separator
from ledgerloom.sources.synthetic import product_master, synthetic_customers, synthetic_sales


def rows(df):
    return [tuple(r) for r in df.collect()]


def save(folder, text, encoding="utf-8", name="t.csv"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_formats():
    assert [detect_format(n) for n in ("a.CSV", "b.json", "c.parquet/", "d.csv.gz")] == [
        "csv",
        "json",
        "parquet",
        "csv",
    ]
    with pytest.raises(ValueError):
        detect_format("a.xlsx")


def test_plain_csv(spark, tmp_path):
    df = read_table(spark, save(tmp_path, "A,B\n1,x\n2,\"y, \"\"z\"\"\"\n"))
    assert df.columns == ["A", "B"] and rows(df) == [(1, "x"), (2, 'y, "z"')]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "latin-1"])
@pytest.mark.parametrize("sep", [";", "\t", ",", "|"])
def test_encodings_and_separators(spark, tmp_path, encoding, sep):
    text = f"Name{sep}N\nJosé{sep}1\nZoë{sep}2\n"
    df = read_csv(spark, save(tmp_path, text, encoding))
    assert df.columns == ["Name", "N"]
    assert rows(df) == [("José", 1), ("Zoë", 2)]


def test_separator_inside_quotes_does_not_count():
    assert sniff_separator(['a;b', '"x,y,z";1', '"p,q,r";2']) == ";"
    assert sniff_separator([]) == ","
    assert sniff_separator(["single", "column"]) == ","


def test_ragged_lines_and_nul(spark, tmp_path):
    path = save(tmp_path, "a,b\n1,x\x00y\n2,p,extra\n3\n4,z\n")
    assert rows(read_csv(spark, path)) == [(1, "xy"), (3, None), (4, "z")]
    assert [r[0] for r in rows(read_csv(spark, path, bad_lines="cut"))] == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        read_csv(spark, path, bad_lines="warn")


def test_kinds_of_columns(spark, tmp_path):
    text = "i,x,flag,day,mixed,none,big\n1,1.5,True,2024-01-01,1,NA,1\nNA,n/a,false,,x,,99999999999999999999\n 3,1e3,TRUE,2024-01-02,2d,null,3\n"
    df = read_csv(spark, save(tmp_path, text))
    assert [t for _, t in df.dtypes] == [
        "bigint", "double", "boolean", "string", "string", "double", "double"
    ]
    assert rows(df) == [
        (1, 1.5, True, "2024-01-01", "1", None, 1.0),
        (None, None, False, None, "x", None, 1e20),
        (3, 1000.0, True, "2024-01-02", "2d", None, 3.0),
    ]


def test_given_schema(spark, tmp_path):
    df = read_csv(spark, save(tmp_path, "a,b\n01,2\n"), schema="a string, b double")
    assert rows(df) == [("01", 2.0)]


@pytest.mark.parametrize(
    "text",
    [
        '{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n',
        '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]',
        '[\n {"a": 1,\n  "b": "x"},\n {"a": 2, "b": null}\n]',
        '{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": null}}',
    ],
)
def test_json_layouts(spark, tmp_path, text):
    df = read_json(spark, save(tmp_path, text, name="t.json"))
    assert rows(df.select("a", "b")) == [(1, "x"), (2, None)]


def test_json_columns_keep_index_order(spark, tmp_path):
    text = json.dumps({"a": {str(i): i for i in range(12)}})
    assert [r[0] for r in rows(read_json(spark, save(tmp_path, text, name="t.json")))] == list(range(12))


def test_round_trips(spark, table, tmp_path):
    df = table("a int, t timestamp_ntz, s string", (1, datetime(2024, 1, 1, 2, 3, 4, 56789), "x"), (2, None, None))
    write_json(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert '"s":null' in text
    write_csv(df, str(tmp_path / "c"))
    back = read_csv(spark, str(tmp_path / "c"), schema=df.schema)
    assert sorted(rows(back)) == sorted(rows(df))
    with pytest.raises(Exception, match="exists"):
        write_csv(df, str(tmp_path / "c"))


def test_positions_follow_the_file(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).selectExpr("id % 7 AS k", "id").coalesce(1).write.parquet(path)
    df = read_table(spark, path, ordinal=True)
    assert sorted(rows(drop_duplicates(df, ["k"]).drop(ROW_ID))) == [(i, i) for i in range(7)]
    last = drop_duplicates(df, ["k"], "last").drop(ROW_ID)
    assert sorted(rows(last)) == [(i, max(n for n in range(1000) if n % 7 == i)) for i in range(7)]
    text = save(tmp_path, "k,v\na,1\na,2\nb,3\n")
    kept = drop_duplicates(read_csv(spark, text, ordinal=True), ["k"], "last").drop(ROW_ID)
    assert sorted(rows(kept)) == [("a", 2), ("b", 3)]


def test_positions_do_not_stop_filters(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    plan = read_table(spark, path, ordinal=True).filter("id > 3")._jdf.queryExecution().toString()
    assert "GreaterThan(id,3)" in plan


def test_previews(spark, table):
    df = table("a double, b string", (1.0, "x"), (float("nan"), None), (3.0, "z"))
    assert sample_records(df, 2) == [{"a": 1.0, "b": "x"}, {"a": None, "b": None}]
    assert describe(df)["shape"] == [3, 2]
    assert rows(preview(df.filter("b is not null"), 1, 1, ["b"])) == [(3.0, "z")]
    assert spark.range(50).transform(lambda d: preview(d, None, None, ["id"])).count() == 20
    with pytest.raises(ValueError):
        preview(df)


def test_several_tables(table):
    tables = {"Jan": table("A int", 1), "Feb": table("a int", 2), "Notes": table("t string", "x")}
    assert list(select_tables(tables, ["Feb", "0", 7, "no"])) == ["Feb", "Jan"]
    assert list(select_tables(tables)) == list(tables)
    with pytest.raises(ValueError):
        select_tables(tables, ["no"])
    assert describe_tables(tables, ["Jan", "Feb"])["merged"] is True
    merged = describe_tables(tables, merge_identical=True)
    assert merged["merged_sheets"] == ["Jan", "Feb"] and merged["shape"] == [2, 1]
    assert list(describe_tables(tables)["sheets"]) == list(tables)
    assert describe_tables(tables, ["Notes"])["columns"] == ["t"]


def test_generated_tables(spark):
    sales = synthetic_sales(spark, 500)
    assert sales.columns[:3] == ["Order ID", "Date", "Customer ID"]
    bad = sales.filter(
        "NOT (Quantity BETWEEN 1 AND 19 AND `Unit Price` BETWEEN 5 AND 500 "
        "AND Discount <= 0.1 * Quantity * `Unit Price` + 0.01 "
        "AND COGS BETWEEN 0.55 * Revenue - 0.01 AND 0.8 * Revenue + 0.01 "
        "AND Expenses BETWEEN 0.02 * Revenue - 0.01 AND 0.08 * Revenue + 0.01 "
        "AND Date BETWEEN '2023-01-01' AND '2025-12-31')"
    )
    assert sales.count() == 500 and bad.count() == 0
    assert sales.select("Order ID").distinct().count() == 500
    assert rows(sales.limit(5)) == rows(synthetic_sales(spark, 500).limit(5))
    customers = synthetic_customers(spark)
    assert customers.count() == customers.select("Customer ID").distinct().count() == 3500
    assert product_master(spark).count() == 5


def test_the_whole_file_decides(spark, tmp_path):
    plain = "".join(f"{i},plain\n" for i in range(60))
    latin = read_csv(spark, save(tmp_path, f"a,b\n{plain}60,José\n", "latin-1"))
    assert (60, "José") in rows(latin)
    with_nul = read_csv(spark, save(tmp_path, f"a,b\n{plain}60,x\x00y\n", name="n.csv"))
    assert (60, "xy") in rows(with_nul)
    # A valid replacement character is no sign of another encoding.
    marked = read_csv(spark, save(tmp_path, f"a,b\n{plain}60,é�\n", name="m.csv"))
    assert (60, "é�") in rows(marked)


@pytest.mark.parametrize("schema", [None, "a bigint, b string"])
def test_line_breaks_inside_quotes(spark, table, tmp_path, schema):
    values = [(1, "x\ny"), (2, '"q"\r\n,'), (3, "  kept  "), (4, "plain"), (5, 'say "hi"')]
    write_csv(table("a bigint, b string", *values).coalesce(1), str(tmp_path / "c"))
    assert sorted(rows(read_csv(spark, str(tmp_path / "c"), schema=schema))) == values


def test_no_line_goes_unnoticed(spark, tmp_path):
    path = save(tmp_path, "a,b\n1,x\n2,p,extra\n")
    with pytest.warns(UserWarning, match="1 lines"):
        assert rows(read_csv(spark, path)) == [(1, "x")]
    with pytest.raises(Exception, match="too many fields"):
        rows(read_csv(spark, path, schema="a int, b string"))
    assert rows(read_csv(spark, path, schema="a int, b string", bad_lines="skip")) == [(1, "x")]


def test_long_lines_stay_off_the_driver(spark, tmp_path):
    line = json.dumps({"a": "x" * 200_000})
    path = save(tmp_path, line + "\n", name="t.json")
    assert max(map(len, first_lines(spark, path))) == SNIFF_CHARS + 1
    assert len(rows(read_json(spark, path))[0][0]) == 200_000


def test_json_columns_of_many_rows_and_types(spark, tmp_path):
    n = 30_000
    table = {
        "i": {str(k): k for k in range(n)},
        "x": {str(k): k / 4 for k in range(n)},
        "mixed": {"0": 1, "1": 2.5, "2": None},
        "text.dotted": {str(k): f"t{k}" for k in range(0, n, 2)},
        "flag": {"5": True},
        "nested": {"0": {"a": [1, 2]}},
        "any": {"0": 1, "1": "one", "2": {"a": 1}},
        "none": {"0": None},
    }
    df = read_json(spark, save(tmp_path, json.dumps(table), name="t.json"), ordinal=True)
    assert df.columns[:8] == list(table)
    assert [f.dataType.simpleString() for f in df.schema.fields[:5]] == ["bigint", "double", "double", "string", "boolean"]
    got = df.collect()
    assert len(got) == n and [r["i"] for r in got] == list(range(n)) and got[7]["x"] == 1.75
    assert [r["mixed"] for r in got[:4]] == [1.0, 2.5, None, None]
    assert (got[2]["text.dotted"], got[3]["text.dotted"], got[5]["flag"]) == ("t2", None, True)
    assert got[0]["nested"]["a"] == [1, 2] and [r["any"] for r in got[:3]] == ["1", "one", '{"a":1}']
    stated = read_json(spark, str(tmp_path / "t.json"), layout="columns", schema="x double, i string")
    assert tuple(stated.first()) == (0.0, "0")
