"""Every registered query against its SQL, and the plans behind them."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.analytics(), entry.analytics_sql()
COUNT_RUNS = {"run_radar", "return_vs_drawdown", "multi_nav"}  # end in one count of the runs, a row per task


@pytest.fixture(scope="module")
def con():
    return oracle.database(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and SQL.items() <= entry.oracle_sql().items()


def test_entry(spark):
    assert entry.entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    built = QUERIES[name](spark, SF_DIR)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan or name in COUNT_RUNS
    expected = con.sql(SQL[name]).to_arrow_table()
    assert oracle.compare(built.toArrow(), expected) == []


def test_fixtures_reach_every_branch(spark):
    rows = lambda name: QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    coverage = rows("signal_day_coverage")
    assert any(not r["has_fills"] for r in coverage) and any(r["days_signal_only"] and r["days_with_fill"] for r in coverage)
    assert any(r["conversion"] is None for r in rows("signal_fill_monthly"))
    daily = rows("signal_fill_daily")
    assert any(r["signals"] == 0 for r in daily) and any(r["fills"] == 0 for r in daily)
    assert any(r["z"] is not None for r in rows("zscore_default"))
