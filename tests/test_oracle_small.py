"""Registered queries against their DuckDB twins at sf0.001 (a fast subset;
tests/run_oracle.py runs every query at any scale)."""

import pytest

import __spark_entry__ as E
from oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"
SUBSET = ["profit_by_hour", "profit_by_factor", "price_grid", "segment_optimal_prices", "shift_allocation",
          "moving_average_forecast", "customer_rfm", "restaurant_sites_distinct", "dynamic_prices"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    assert compare(df, con, E.oracle_sql()[name]) == []


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "profit_mean" in df.columns
