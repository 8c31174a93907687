"""Every named query against DuckDB on the same tables."""

import oracle
import pytest

import __spark_entry__ as contract
from ledgerloom.plans import catalog


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, con, name):
    assert oracle.differences(catalog.QUERIES[name](spark, data), con, catalog.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_contract(spark, data):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["l_returnflag", "n", "net_profit_mean"]
    assert contract.entry(spark).count() == 3
