"""Physical plans: what is read, what is shuffled, and how a run with most of the rows is spread."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stratlens.operators import trades
from stratlens.operators.joins import salted_join

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name in settings:
        spark.conf.unset(name)


def test_columns_are_pruned(spark):
    text = plan(entry.queries()["monthly_returns"](spark, SF_DIR))
    for unused in ("l_orderkey", "l_quantity", "p_name", "p_type"):
        assert unused not in text
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_partkey)]" in text


def test_windows_share_one_exchange(spark):
    text = plan(entry.queries()["run_scorecard"](spark, SF_DIR))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2  # the daily grouping, and the series


def test_rank_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["largest_spreads"](spark, SF_DIR))


def skewed(spark):
    """One run with a hundred times the trades of the others."""
    ids = spark.range(20200).withColumn("run_id", F.when(F.col("id") < 20000, "hot").when(F.col("id") < 20100, "a").otherwise("b"))
    return ids.select("run_id", F.col("id").alias("trade"), ((F.col("id") * 7919) % 1009).cast("double").alias("gross_pnl"))


def test_hot_run_is_dealt_over_many_tasks(spark, no_broadcast):
    rows = skewed(spark)
    text = plan(trades.histogram(rows, "gross_pnl"))
    assert "BroadcastHashJoin" not in text and re.search(r"hashpartitioning\(run_id#\d+, _salt#\d+", text)
    facts = rows.groupBy("run_id").agg(F.max("gross_pnl").alias("top"))
    dealt = salted_join(rows, facts, ["run_id"]).withColumn("task", F.spark_partition_id())
    sizes = dealt.filter("run_id = 'hot'").groupBy("task").count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 15000 and dealt.count() == 20200


def test_hot_run_results(spark, no_broadcast):
    counts = {r["run_id"]: r["n"] for r in trades.histogram(skewed(spark), "gross_pnl").groupBy("run_id").agg(F.sum("n").alias("n")).collect()}
    assert counts == {"hot": 20000, "a": 100, "b": 100}
    area = trades.density(skewed(spark), "gross_pnl").groupBy("run_id").agg(F.count("x").alias("n"))
    assert {r["n"] for r in area.collect()} == {200}


def scanned(df) -> set[str]:
    return {f.rsplit("/", 2)[-2] for f in df.inputFiles()}


def test_shared_tables_are_made_once(spark, tmp_path):
    """One match, one totals, one cells and one net-value job; the reports read what these wrote, with equal results."""
    from stratlens.fixtures import FixtureTables
    from stratlens.plans import reports
    from stratlens.sources.tables import RunTables

    given = FixtureTables(spark, SF_DIR)
    names = ("portfolio", "symbol", "trades", "signals", "rolls")
    for name in names:
        getattr(given, name).write.parquet(f"{tmp_path}/in/{name}")
    tables = RunTables.of(spark, **{name: spark.read.parquet(f"{tmp_path}/in/{name}") for name in names})
    bars = entry.view(spark, SF_DIR, "fx_bars")
    plain = reports.build_reports(tables, "all", bars=bars, compare_runs=True)
    built = reports.build_reports(tables, "all", bars=bars, compare_runs=True, shared_root=f"{tmp_path}/shared")
    assert list(built) == list(plain)
    for name in ("roundtrips", "roundtrip_pnl_hist", "roundtrip_pnl_density", "holding_hours_hist", "holding_hours_density"):
        assert scanned(built[name]) == {"matched"}, name
    for name in ("spread_correlation", "active_spread_count"):
        assert scanned(built[name]) == {"cells"}, name
    assert scanned(built["spread_contribution"]) == {"totals", "trades"}
    for name in ("nav_drawdown", "rolling_metrics", "multi_nav", "run_scorecard"):
        assert scanned(built[name]) == {"portfolio"} and "/shared/" in built[name].inputFiles()[0], name
    assert scanned(built["spread_nav_picks"]) == {"totals", "symbol", "portfolio"}
    assert scanned(built["spread_month_matrix"]) == {"totals", "symbol"}
    for name in ("spread_contribution", "spread_nav_picks", "spread_month_matrix", "zscore_bars", "zscore_events"):
        assert "sum(daily_pnl#" in plan(plain[name]) and "sum(daily_pnl#" not in plan(built[name]), name

    def rounded(df):
        return sorted(str([round(v, 5) + 0.0 if isinstance(v, float) else v for v in r]) for r in df.collect())

    for name in ("roundtrips", "spread_correlation", "spread_contribution", "spread_nav_picks", "rolling_metrics", "roll_events", "zscore_events"):
        assert rounded(built[name]) == rounded(plain[name]), name


def test_reports_keep_the_input_lazy(spark):
    """Building any query runs no job on the data."""
    tracker = spark.sparkContext.statusTracker()
    for table in ("lineitem", "part", "orders", "events"):
        entry.raw(spark, SF_DIR, table)  # columns are looked up once
    before = len(tracker.getJobIdsForGroup(None))
    for name, build in entry.analytics().items():
        build(spark, SF_DIR)
        assert len(tracker.getJobIdsForGroup(None)) == before, name
