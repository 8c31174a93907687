"""Date steps, hand-computed."""

from datetime import datetime

import pytest

from ledgerloom import filter_date_range, flag_weekend, sort_by_date, standardize_date
from ledgerloom.functions.dates import layout_shape, period_start
from ledgerloom.functions.names import c


def column(df, name):
    return [row[name] for row in df.collect()]


def test_many_layouts(table):
    df = table(
        "d string",
        "2024-03-01",
        "2024-03-01 10:30:00",
        "2024-03-01T10:30:00Z",
        " 03/01/2024 ",
        "13/03/2024",
        "3/1/2024 4:05",
        "Mar 1, 2024",
        "1 March 2024",
        "20240301",
        "junk",
        "",
        None,
    )
    first = datetime(2024, 3, 1)
    # Month first is stated: by their votes these texts would be read day first (13/03/2024).
    assert column(standardize_date(df, ["d"], dayfirst=False), "d") == [
        first,
        datetime(2024, 3, 1, 10, 30),
        datetime(2024, 3, 1, 10, 30),
        first,
        datetime(2024, 3, 13),
        datetime(2024, 3, 1, 4, 5),
        first,
        first,
        first,
        None,
        None,
        None,
    ]


def test_hours_that_a_time_zone_skips_are_kept(table):
    # 02:30 on this day does not exist in the session's zone, America/New_York.
    df = standardize_date(table("d string", "2024-03-10 02:30:00", "3/10/2024 2:30"), ["d"])
    assert column(df, "d") == [datetime(2024, 3, 10, 2, 30)] * 2


def test_own_layouts(table):
    df = table("d string", "2024|03|01", "01.03.24")
    parsed = standardize_date(df, ["d"], formats=["yyyy|MM|dd", "dd.MM.yy"])
    assert column(parsed, "d") == [datetime(2024, 3, 1)] * 2


def test_layout_shape():
    assert layout_shape("dd.MM.yy") is None
    assert layout_shape("M/d/yyyy[ H:mm]").startswith(r"\A(?:0?[1-9]|1[0-2])/")


def test_default_column_and_wrong_types(table):
    assert column(standardize_date(table("Date string", "2024-01-02")), "Date") == [
        datetime(2024, 1, 2)
    ]
    assert standardize_date(table("x int", 1)).columns == ["x"]
    with pytest.raises(ValueError, match="holds no dates"):
        standardize_date(table("d int", 1), ["d"])
    with pytest.raises(ValueError, match="not in the table"):
        standardize_date(table("d int", 1), ["e"])


def test_range_is_inclusive_and_ends_at_midnight(table):
    df = table("Date string", "2025-01-08", "2025-01-10", "2025-01-10 10:00:00", "x")
    inside = filter_date_range(df, "Date", "2025-01-08", "2025-01-10")
    assert column(inside, "Date") == [datetime(2025, 1, 8), datetime(2025, 1, 10)]
    assert filter_date_range(df, "Date").count() == 4  # parsed, nothing dropped
    assert filter_date_range(df, "Date", end="01/09/2025").count() == 1
    with pytest.raises(ValueError):
        filter_date_range(df, "Date", "soon")


def test_sort_puts_nulls_last_both_ways(table):
    df = table("d string", "b", None, "a")
    assert column(sort_by_date(df, "d"), "d") == ["a", "b", None]
    assert column(sort_by_date(df, "d", "desc"), "d") == ["b", "a", None]
    assert column(sort_by_date(df, "d", "DOWN"), "d") == ["a", "b", None]


def test_weekend(table):
    df = table("x int, `Ship Date` string", (1, "2024-03-01"), (2, "2024-03-02"), (3, None))
    assert column(flag_weekend(df), "Weekend") == [False, True, False]
    with pytest.raises(ValueError):
        flag_weekend(table("x int", 1))


@pytest.mark.parametrize(
    "freq, want",
    [
        ("D", datetime(2024, 5, 16)),
        ("W", datetime(2024, 5, 13)),
        ("M", datetime(2024, 5, 1)),
        ("Q", datetime(2024, 4, 1)),
        ("Y", datetime(2024, 1, 1)),
    ],
)
def test_period_starts(table, freq, want):
    df = standardize_date(table("d string", "2024-05-16 23:59:59"), ["d"])
    assert df.select(period_start(c("d"), freq)).first()[0] == want
    with pytest.raises(ValueError):
        period_start(c("d"), "fortnight")


def test_one_layout_per_column(table):
    df = table(
        "d string, m string, one string",
        ("13/02/2024", "2/13/2024", "05/02/2024"),
        ("05/02/2024", "05/02/2024", None),
        ("28/02/2024", "2/28/2024", "x"),
    )
    out = standardize_date(df, ["d", "m", "one"])
    assert column(out, "d") == [datetime(2024, 2, 13), datetime(2024, 2, 5), datetime(2024, 2, 28)]
    assert column(out, "m") == [datetime(2024, 2, 13), datetime(2024, 5, 2), datetime(2024, 2, 28)]
    assert column(out, "one") == [datetime(2024, 5, 2), None, None]  # a tie: month first
    assert column(standardize_date(df, ["one"], dayfirst=True), "one")[0] == datetime(2024, 2, 5)
    assert column(standardize_date(df, ["d"], dayfirst=False), "d")[1] == datetime(2024, 5, 2)
    own = standardize_date(df, ["one"], ("d/M/yyyy", "M/d/yyyy"), dayfirst=False)
    assert column(own, "one")[0] == datetime(2024, 5, 2)


def test_day_first_range_and_recipe(table):
    from ledgerloom import run_recipe

    df = table("d string", "13/02/2024", "05/02/2024", "28/03/2024")
    step = {"type": "filterDateRange", "config": {"col": "d", "from": "2024-02-01", "to": "2024-02-20"}}
    assert sorted(column(run_recipe(df, [step]).df, "d")) == [datetime(2024, 2, 5), datetime(2024, 2, 13)]
    step = {"type": "standardizeDate", "config": {"col": "d", "dayfirst": False}}
    assert column(run_recipe(df, [step]).df, "d")[1] == datetime(2024, 5, 2)
