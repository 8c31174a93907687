import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(__file__)]

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]")
        .appName("ledgerloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("driver tables are not on this machine")
    return DATA


@pytest.fixture
def table(spark):
    """table(ddl, rows...) -> DataFrame"""

    def build(ddl, *rows):
        return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)

    return build


@pytest.fixture
def sales(table):
    """Ten days of sales; net profit of day i is 200 + 20 i."""
    rows = [
        (
            f"2025-01-{i + 1:02d}",
            1000 + 50 * i,
            600 + 20 * i,
            200 + 10 * i,
            "Debit" if i % 2 == 0 else "Credit",
            f"ACC{i:04d}",
        )
        for i in range(10)
    ]
    ddl = "Date string, Revenue bigint, COGS bigint, Expenses bigint, Type string, `Account No` string"
    return table(ddl, *rows)
