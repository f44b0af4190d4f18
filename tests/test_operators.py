"""Pinned values, missing inputs, constants, ties and short series."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from stratlens.functions import columns
from stratlens.operators import compare, factors, returns, rolling, signals, trades, universe
from stratlens.plans import reports
from stratlens.sources.runs import normalize
from stratlens.sources.tables import RunTables
from stratlens.schemas import PORTFOLIO, PORTFOLIO_HEADERS

DAY0 = dt.date(2024, 1, 1)


def day(i: int) -> dt.date:
    return DAY0 + dt.timedelta(days=i)


def at(i: int, hour: int = 9, minute: int = 0) -> dt.datetime:
    return dt.datetime.combine(day(i), dt.time(hour, minute))


def portfolio(spark, series: dict[str, list[float | None]], extra: dict[str, float] | None = None):
    rows = [(run, day(i), r) for run, values in series.items() for i, r in enumerate(values)]
    df = spark.createDataFrame(rows, "run_id string, date date, daily_pnl_pct double")
    for name, value in (extra or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df


def symbol(spark, rows):
    """Rows ``run, spread, day, pnl, pct``."""
    data = [(run, spread, day(d), pnl, pct, 1.0) for run, spread, d, pnl, pct in rows]
    return spark.createDataFrame(
        data, "run_id string, spread string, date date, daily_pnl double, daily_pnl_pct double, commission double"
    )


def test_additive_nav_and_drawdown(spark):
    df = portfolio(spark, {"a": [0.1, 0.05, -0.08, 0.02], "b": [0.01, None, -0.02, 0.01]})
    rows = reports.nav_drawdown(df).orderBy("run_id", "date").collect()
    assert rows[3]["nav"] == pytest.approx(1.09)
    assert all(r["drawdown"] <= 0 for r in rows)
    assert [r["nav"] for r in rows[4:]] == pytest.approx([1.01, 1.01, 0.99, 1.0])


def test_summary(spark):
    df = portfolio(spark, {"a": [0.1, 0.05, -0.08, 0.02], "one": [0.01], "flat": [0.01, 0.01], "loss": [-0.05, 0.02], "zero": [0.0, None]})
    rows = {r["run_id"]: r for r in returns.summarize_returns(df).collect()}
    a = rows["a"]
    assert (a["days"], a["active_days"], a["total_return"], a["max_drawdown"]) == (4, 4, 0.09, -0.08)
    assert a["annual_return"] == pytest.approx(round(0.09 / 4 * 244, 6))
    sd = statistics.stdev([0.1, 0.05, -0.08, 0.02])
    assert a["sharpe"] == pytest.approx(round(0.0225 / sd * math.sqrt(244), 4))
    assert a["calmar"] == pytest.approx(round(0.09 / 4 * 244 / 0.08, 4)) and a["win_rate"] == 0.75
    assert rows["one"]["sharpe"] == 0.0 and rows["flat"]["sharpe"] == 0.0 and rows["flat"]["calmar"] is None
    # The peak starts at the first value, so an opening loss is no drawdown.
    assert rows["loss"]["max_drawdown"] == 0.0
    assert (rows["zero"]["active_days"], rows["zero"]["win_rate"], rows["zero"]["total_return"]) == (0, 0.0, 0.0)


def test_supplied_net_value_wins_per_run(spark):
    df = portfolio(spark, {"a": [0.1, 0.1], "b": [0.1, 0.1]})
    df = df.withColumn("net_value", F.when((F.col("run_id") == "a") & (F.col("date") == F.lit(day(0))), 5.0))
    rows = {(r["run_id"], r["date"]): r["nav"] for r in returns.portfolio_nav(df).collect()}
    assert rows["a", day(0)] == 5.0 and rows["a", day(1)] is None
    assert rows["b", day(1)] == pytest.approx(1.2)
    cut = df.withColumn("block", F.col("date"))
    assert {(r["run_id"], r["date"]): r["nav"] for r in returns.portfolio_nav(cut, block="block").collect()} == rows


def test_relative_drawdown(spark):
    df = spark.createDataFrame(
        [("a", day(i), v) for i, v in enumerate([0.0, 2.0, 1.0, None, 4.0])], "run_id string, date date, nav double"
    )
    got = [r["drawdown"] for r in returns.drawdown_relative(df).orderBy("date").collect()]
    assert got == [None, 0.0, 0.5, None, 0.0]


def test_cost_curves_add_up(spark):
    df = portfolio(spark, {"a": [0.0] * 3}).withColumn("commission", F.lit(2.0)).withColumn(
        "daily_pnl", F.when(F.col("date") != F.lit(day(1)), 10.0)
    )
    rows = reports.cost_curves(df).orderBy("date").collect()
    assert [(r["cum_gross"], r["cum_net"], r["cum_commission"]) for r in rows] == [(12, 10, 2), (None, None, 4), (24, 20, 6)]


def test_calendar_returns(spark):
    rng = random.Random(3)
    df = portfolio(spark, {"a": [rng.gauss(0, 0.01) for _ in range(400)], "b": [0.01] * 5})
    monthly = returns.monthly_returns(df)
    total = {r["run_id"]: r["t"] for r in monthly.groupBy("run_id").agg(F.sum("ret").alias("t")).collect()}
    assert total["a"] == pytest.approx({r["run_id"]: r["t"] for r in df.groupBy("run_id").agg(F.sum("daily_pnl_pct").alias("t")).collect()}["a"])
    assert monthly.filter("run_id = 'b'").first()["label"] == "2024-01"
    # One month makes no matrix.
    assert {r["run_id"] for r in returns.month_matrix(df).collect()} == {"a"}
    assert returns.annual_returns(df).filter("run_id = 'a'").count() == 2


def model_drawdown(navs, window):
    out = []
    for i in range(len(navs)):
        part = navs[max(0, i - window + 1) : i + 1]
        if len(part) < window or None in part:
            out.append(None)
            continue
        peak, dip = -math.inf, 0.0
        for v in part:
            peak = max(peak, v)
            dip = min(dip, v - peak)
        out.append(dip)
    return out


def test_rolling_metrics_against_loop(spark):
    rng = random.Random(5)
    values = {"a": [round(rng.gauss(0, 0.01), 6) for _ in range(150)], "short": [0.01] * 4, "flat": [0.01] * 12}
    df = returns.portfolio_nav(portfolio(spark, values))
    df = df.withColumn("nav", F.when(~((F.col("run_id") == "a") & (F.col("date") == F.lit(day(70)))), F.col("nav")))
    rows = {(r["run_id"], r["date"], r["window"]): r for r in rolling.rolling_metrics(df, (5, 20)).collect()}
    assert len(rows) == 2 * (150 + 4 + 12)
    navs = {r: [x["nav"] for x in df.filter(F.col("run_id") == r).orderBy("date").collect()] for r in values}
    for run, rets in values.items():
        for w in (5, 20):
            for i, dip in enumerate(model_drawdown(navs[run], w)):
                row = rows[run, day(i), w]
                assert (row["max_drawdown"] is None) == (dip is None)
                if dip is not None:
                    assert row["max_drawdown"] == pytest.approx(dip, abs=1e-12)
                part = rets[max(0, i - w + 1) : i + 1]
                if len(part) < w or len(set(part)) == 1:
                    assert row["sharpe"] is None
                else:
                    assert row["sharpe"] == pytest.approx(statistics.mean(part) / statistics.stdev(part) * math.sqrt(244), abs=1e-7)
    one = rolling.rolling_max_drawdown(df, 5).filter("run_id = 'a'").orderBy("date").collect()
    assert [r["max_drawdown"] for r in one] == pytest.approx(model_drawdown(navs["a"], 5), abs=1e-12)


def fills(spark, rows):
    data = [("r", "s1", "A&B", t, d, o, p, 1, 1.0, i) for i, (t, d, o, p) in enumerate(rows)]
    return spark.createDataFrame(
        data,
        "run_id string, instance_id string, spread string, datetime timestamp_ntz, direction string, offset string, price double, volume int, commission double, row_id bigint",
    )


def test_roundtrip_pinned(spark):
    one = fills(spark, [(at(0), "LONG", "OPEN", 100.0), (at(0, 15), "SHORT", "CLOSE", 110.0)])
    row = reports.roundtrips(one).first()
    assert row["gross_pnl"] == 8.0 and row["holding_minutes"] == 360.0 and row["commission"] == 2.0
    twice = fills(
        spark,
        [(at(0), "LONG", "OPEN", 100.0), (at(1), "LONG", "OPEN", 105.0), (at(2), "SHORT", "CLOSE", 110.0), (at(3), "SHORT", "CLOSE", 111.0)],
    )
    rows = reports.roundtrips(twice).collect()
    assert len(rows) == 1 and rows[0]["open_price"] == 105.0
    short = fills(spark, [(at(0), "SHORT", "open", 100.0), (at(1), "LONG", "close", 90.0)])
    assert reports.roundtrips(short).first()["gross_pnl"] == 8.0


def test_histogram_edges(spark):
    df = spark.createDataFrame([("a", v) for v in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)] + [("same", 2.0)] * 3 + [("none", None)], "run_id string, v double")
    rows = trades.histogram(df, "v", 10).collect()
    a = {r["bin"]: r["n"] for r in rows if r["run_id"] == "a"}
    edges = [0.0 + i * (1.0 / 10) for i in range(10)] + [1.0]
    expected = {i: 0 for i in range(10)}
    for v in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0):
        expected[max(i for i in range(10) if v >= edges[i])] += 1
    assert a == expected
    same = [r for r in rows if r["run_id"] == "same"]
    assert (same[0]["lo"] if same[0]["bin"] == 0 else 1.5) == 1.5 and sum(r["n"] for r in same) == 3
    assert not [r for r in rows if r["run_id"] == "none"]


def test_density_integrates(spark):
    rng = random.Random(2)
    values = [rng.gauss(5, 2) for _ in range(500)] + [500.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("flat", 1.0)] * 3, "run_id string, v double")
    rows = trades.density(df, "v", points=50).orderBy("point").collect()
    assert {r["run_id"] for r in rows} == {"a"} and len(rows) == 50
    h = statistics.stdev(values) * len(values) ** -0.2
    for r in rows:
        exact = sum(math.exp(-0.5 * ((r["x"] - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=1e-9, abs=0.0)


def test_holding_needs_some_time(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 90.0), ("b", 0.0)], "run_id string, holding_minutes double")
    rows = trades.histogram(reports.holding_hours(df), "hours", 3, above=0.0).orderBy("bin").collect()
    assert [(r["run_id"], r["lo"], r["hi"], r["n"]) for r in rows] == [("a", 0.0, 0.5, 1), ("a", 0.5, 1.0, 0), ("a", 1.0, 1.5, 1)]


def test_picks(spark):
    rows = [("r", s, 0, p, p / 1000) for s, p in zip("ABCDEFG", (5.0, 5.0, 3.0, 0.0, 0.0, -1.0, -2.0))]
    totals = universe.spread_totals(symbol(spark, [*rows, ("one", "A", 0, 1.0, 0.1), ("r", None, 0, 9.0, 0.9)]))
    top = universe.top_bottom_spreads(totals, 2).orderBy("run_id", "pick").collect()
    assert [(r["run_id"], r["spread"]) for r in top] == [("one", "A"), ("r", "A"), ("r", "B"), ("r", "F"), ("r", "G")]
    everything = universe.top_bottom_spreads(totals, 6).filter("run_id = 'r'").orderBy("pick")
    assert "".join(r["spread"] for r in everything.collect()) == "ABCDEFG"
    diagnostic = universe.diagnostic_spreads(totals, 1).filter("run_id = 'r'").orderBy("pick")
    assert "".join(r["spread"] for r in diagnostic.collect()) == "AGD"
    assert "".join(r["spread"] for r in universe.largest_spreads(totals, 3).filter("run_id = 'r'").orderBy("rank").collect()) == "ABC"
    assert {r["run_id"] for r in universe.active_spreads(totals).collect()} == {"r"}


def test_missing_profit_counts_as_active(spark):
    df = symbol(spark, [("r", "A", 0, None, 0.0), ("r", "B", 0, 0.0, 0.0), ("r", "C", 0, 1.0, 0.0)])
    assert universe.active_spreads_per_day(df).first()["active_spreads"] == 2
    assert {r["spread"] for r in universe.active_spreads(universe.spread_totals(df)).collect()} == {"A", "C"}


def pearson(x, y):
    mx, my = sum(x) / len(x), sum(y) / len(y)
    cov = sum((a - mx) * (b - my) for a, b in zip(x, y))
    return cov / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def test_correlation_with_gaps_and_constants(spark):
    rng = random.Random(9)
    series = {s: [rng.gauss(0, 0.01) if rng.random() < 0.6 else None for _ in range(60)] for s in "ABC"}
    series["D"] = [0.25] * 60
    series["E"] = [0.0] * 60
    series["F"] = [0.125 if i % 2 else None for i in range(60)]
    rows = [("r", s, i, 1.0, v) for s, vs in series.items() for i, v in enumerate(vs) if v is not None]
    got = {(r["s1"], r["s2"]): r["corr"] for r in universe.spread_correlation(symbol(spark, rows)).collect()}
    assert len(got) == 36
    dense = {s: [v or 0.0 for v in vs] for s, vs in series.items()}
    for a in series:
        for b in series:
            if a in "DE" or b in "DE":
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(pearson(dense[a], dense[b]), abs=1e-9)
    breadth = {r["date"]: r["n"] for r in universe.active_spread_count(symbol(spark, rows)).collect()}
    assert breadth == {day(i): sum(1 for s in dense if dense[s][i] != 0) for i in range(60)}


def test_correlation_of_large_levels(spark):
    rng = random.Random(10)
    series = {s: [1000 + rng.uniform(-1e-3, 1e-3) for _ in range(80)] for s in "AB"}
    rows = [("r", s, i, 1.0, v) for s, vs in series.items() for i, v in enumerate(vs)]
    got = {(r["s1"], r["s2"]): r["corr"] for r in universe.spread_correlation(symbol(spark, rows)).collect()}
    assert got["A", "B"] == got["B", "A"] == pytest.approx(pearson(series["A"], series["B"]), abs=1e-6)


def test_month_matrix_of_spreads(spark):
    rows = [("r", "A", 0, 5.0, 0.1), ("r", "A", 40, 5.0, 0.2), ("r", "B", 0, -1.0, 0.3), ("r", "Z", 80, 0.0, 0.5)]
    got = {(r["spread"], r["ym"]): r["ret"] for r in universe.spread_month_matrix(symbol(spark, rows)).collect()}
    assert got == {("A", "2024-01"): 0.1, ("A", "2024-02"): 0.2, ("B", "2024-01"): 0.3, ("B", "2024-02"): 0.0}


def test_sectors(spark):
    rows = [("r", "A2105&B2102", i, float(v), 0.0) for i, v in enumerate([1, 2, 3, 4, 100])] + [("r", None, 0, 7.0, 0.0)]
    box = {r["sector"]: r for r in universe.sector_box(symbol(spark, rows)).collect()}
    assert (box["A"]["q1"], box["A"]["med"], box["A"]["q3"], box["A"]["whislo"], box["A"]["whishi"]) == (2, 3, 4, 1, 4)
    assert box["NAN"]["med"] == 7.0
    undated = symbol(spark, rows).withColumn("date", F.when(F.col("daily_pnl") != 100, F.col("date")))
    assert {r["sector"]: r["med"] for r in universe.sector_box(undated).collect()} == {"A": 2.5, "NAN": 7.0}
    assert None not in {r["date"] for r in universe.active_spreads_per_day(undated).collect()}
    assert {r["sector"]: r["pnl"] for r in universe.sector_pnl(symbol(spark, rows)).collect()} == {"A": 110.0, "NAN": 7.0}


def signal_rows(spark, rows):
    data = [("r", "A&B", t, 100.0, o, 5.0) for t, o in rows]
    return spark.createDataFrame(
        data, "run_id string, symbol string, action_datetime timestamp_ntz, price double, offset string, bar_oi double"
    )


def test_conversion(spark):
    sig = signal_rows(spark, [(at(0), "open"), (at(0, 10), "close"), (None, "open"), (at(70), "open")])
    trd = fills(spark, [(at(0), "LONG", "OPEN", 1.0)] + [(at(1, h), "LONG", "OPEN", 1.0) for h in (1, 2, 3)])
    daily = signals.signal_fill_daily(sig, trd)
    assert [(r["signals"], r["fills"], r["conversion"]) for r in daily.orderBy("date").collect()] == [(2, 1, 0.5), (0, 3, 0.0), (1, 0, 0.0)]
    monthly = [tuple(r)[1:] for r in signals.signal_fill_monthly(daily).orderBy("month_end").collect()]
    assert monthly == [(dt.date(2024, 1, 31), 0.25), (dt.date(2024, 2, 29), None), (dt.date(2024, 3, 31), 0.0)]


def test_signal_days(spark):
    sig = signal_rows(spark, [(at(0), "open"), (at(1), "open"), (at(2), "OPEN"), (at(3), "close")])
    other = sig.withColumn("run_id", F.lit("unfilled"))
    trd = fills(spark, [(at(0), "LONG", "OPEN", 1.0), (at(5), "LONG", "OPEN", 1.0)])
    rows = {r["run_id"]: tuple(r)[1:] for r in signals.signal_day_coverage(sig.union(other), trd).collect()}
    assert rows == {"r": (True, 1, 1), "unfilled": (False, 0, 2)}
    assert signals.open_signal_oi(sig).count() == 2


def test_rolls(spark):
    df = portfolio(spark, {"a": [0.0] * 3, "b": [0.0]})
    rolls = spark.createDataFrame([("a", day(1)), ("a", day(1)), ("a", None), ("a", day(9))], "run_id string, tradingday date")
    rows = signals.roll_events(df, rolls).orderBy("date").collect()
    assert [(r["run_id"], r["is_roll"], r["roll_count"]) for r in rows] == [("a", False, 2), ("a", True, 2), ("a", False, 2)]


def test_chart_events(spark):
    picks = spark.createDataFrame([("r", "A&B")], "run_id string, spread string")
    sig = signal_rows(spark, [(at(0), "open"), (at(0), "OPEN")])
    trd = fills(spark, [(at(1), "LONG", "open", 1.0), (at(2), "LONG", "Close", 1.0), (at(3), "LONG", "CLOSETODAY", 1.0)])
    kinds = sorted(r["kind"] for r in signals.chart_events(picks, sig, trd).collect())
    assert kinds == ["entry", "fill_close", "fill_open"]


def test_radar_needs_two_runs(spark):
    extra = {"daily_pnl": 100.0, "commission": 50.0}
    two = compare.run_scorecard(portfolio(spark, {"a": [0.1, 0.05, -0.08, 0.02], "b": [-0.1, -0.2]}, extra))
    axes = {(r["run_id"], r["axis"]): r["value"] for r in compare.run_radar(two).collect()}
    assert len(axes) == 10 and axes["a", "total_return"] == pytest.approx(0.9) and axes["b", "total_return"] == 0.0
    assert axes["a", "net_of_commission"] == pytest.approx(1 - 200 / 600)
    assert compare.return_vs_drawdown(two).count() == 2
    assert compare.run_radar(two.filter("run_id = 'a'")).count() == 0
    both = portfolio(spark, {"a": [0.1, 0.05], "b": [-0.1]}, extra)
    assert compare.multi_nav(both).count() == 3 and compare.multi_nav(both.filter("run_id = 'a'")).count() == 0


def test_quantile_spread_needs_two_curves(spark):
    rows = [("a", day(0), "q5", 0, 10000.0), ("a", day(0), "q3", 1, 1.0), ("a", day(0), "q1", 2, None), ("b", day(0), "ols", 0, 5.0)]
    curves = spark.createDataFrame(rows, "run_id string, date date, strategy string, col_pos int, capital double")
    assert [tuple(r) for r in factors.quantile_spread(curves).collect()] == [("a", day(0), None)]
    whole = returns.capital_to_portfolio(curves, 0).filter("run_id = 'b'").first()
    assert whole["net_value"] == 5.0


def test_names(spark):
    df = spark.createDataFrame([("A2105&B2102",), ("豆2105&粕2102",), ("12345&x",), ("solo9",), ("&b1",), (None,)], "s string")
    got = [tuple(r) for r in df.select(columns.product_prefix("s"), columns.spread_product("s"), columns.spread_pair_folder("s")).collect()]
    assert got == [
        ("A", "a", "A&B"), ("豆", "豆", "豆&粕"), ("12", "1", "&X"), ("SOLO", "solo", "solo9"), ("", "", "&B"), ("NAN", "nan", None),
    ]


def test_numbers_and_times(spark):
    texts = ["1.0d", "1e3", " 5 ", "inf", "", "NA", "0x1", None]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r[0] for r in df.select(columns.lenient_double("s")).collect()] == [None, 1000.0, 5.0, math.inf, None, None, None, None]
    times = ["20240131", "2024-01-31", "2024/1/31 09:30", "20240131 09:30:00", "x"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in times], "s string").select(columns.lenient_timestamp("s")).collect()]
    start = dt.datetime(2024, 1, 31)
    assert got == [start, start, start.replace(hour=9, minute=30), start.replace(hour=9, minute=30), None]


def test_normalize_localised(spark):
    df = spark.createDataFrame([("r", "20240131", "5.5", "x")], "run_id string, `日期` string, `日盈亏` string, other string")
    row = normalize(df, PORTFOLIO_HEADERS, PORTFOLIO).first().asDict()
    assert row["date"] == dt.date(2024, 1, 31) and row["daily_pnl"] == 5.5 and row["other"] == "x" and row["net_value"] is None


def test_empty_tables_give_empty_reports(spark):
    for adapter, group in (("spread", "all"), ("equity", "all")):
        for name, df in reports.build_reports(RunTables.of(spark), group, adapter, compare_runs=True).items():
            assert df.count() == 0, name
    with pytest.raises(ValueError):
        reports.build_reports(RunTables.of(spark), "nothing")


def test_groups():
    assert reports.SPREAD_GROUPS["all"] == tuple(f"{i:02d}" for i in range(1, 16))
    built = set(reports.REPORTS) | {"08"}
    assert set(reports.SPREAD_GROUPS["all"]) | set(reports.EQUITY_GROUPS["all"]) <= built
