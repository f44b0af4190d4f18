"""Small CSV trees: byte-order marks, localised headers, mixed layouts, absent tables."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest

from stratlens.plans import reports
from stratlens.sources.bars import load_bars
from stratlens.sources.equity import load_equity_runs
from stratlens.sources.runs import load_rolls, load_runs, load_summary, load_trades
from stratlens.sources.sink import clear_report, stage_tables, write_report, write_reports


def put(path: Path, text: str, encoding: str = "utf-8") -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)


@pytest.fixture()
def tree(tmp_path: Path) -> Path:
    daily = "daily/portfolio"
    put(
        tmp_path / "run a" / daily / "daily_pnl_portfolio_2024.csv",
        "日期,策略,套利对数,日盈亏,日收益率,手续费,成交笔数,盈利笔数,净值\n"
        "2024-01-03,s,2,20,0.02,1,3,1,1.5\n2024-01-02,s,2,10,0.01,1,3,1,1.4\n",
        "utf-8-sig",
    )
    put(tmp_path / "run a" / daily / "daily_pnl_portfolio_2025.csv", "日期,日盈亏\n2025-01-02,99\n", "utf-8-sig")
    # The second run has other column order, English names, compact dates and missing words.
    put(
        tmp_path / "b+%&c" / daily / "daily_pnl_portfolio_x.csv",
        "daily_pnl_pct,commission,date,daily_pnl,note\nNA,2,20240102,5,hello\n-0.01,null,20240103,-6,\"a,b\"\n",
    )
    put(
        tmp_path / "run a" / "daily/symbol/daily_pnl_all.csv",
        "日期,套利对,策略,日盈亏,日收益率,手续费,成交笔数,盈利笔数,净值\n2024/1/2,A2105&B2102,s,10,0.01,1,3,1,1\n",
        "utf-8-sig",
    )
    put(
        tmp_path / "run a" / "trades/trades.csv",
        "实例ID,价差合约,成交时间,交易日,方向,开平,成交价,成交量,手续费\n"
        "s1,A&B,2024-01-02 09:00:00,2024-01-02,LONG,OPEN,100,1,1\n"
        "s1,A&B,2024-01-02 15:00:00,2024-01-02,SHORT,CLOSE,110,1,1\n",
        "utf-8-sig",
    )
    put(
        tmp_path / "run a" / "signals/signals_1.csv",
        "symbol,action_datetime,bar_datetime,tradingday,offset,price\nA&B,2024-01-02 08:59:00,2024-01-02 08:58:00,oops,open,100\n",
    )
    put(tmp_path / "run a" / "rolls/roll_events.csv", "tradingday,x\n2024-01-03,1\nbad,2\n")
    put(tmp_path / "run a" / "performance/summary.csv", ",sharpe\ntotal,1.5\n", "utf-8-sig")
    put(tmp_path / "not_a_run.txt", "x")
    return tmp_path


def test_all_runs_in_one_table(spark, tree):
    tables = load_runs(spark, str(tree))
    rows = tables.portfolio.orderBy("run_id", "date").collect()
    assert [(r["run_id"], r["date"], r["daily_pnl"], r["daily_pnl_pct"], r["commission"], r["net_value"]) for r in rows] == [
        ("b+%&c", dt.date(2024, 1, 2), 5.0, None, 2.0, None),
        ("b+%&c", dt.date(2024, 1, 3), -6.0, -0.01, None, None),
        ("run a", dt.date(2024, 1, 2), 10.0, 0.01, 1.0, 1.4),
        ("run a", dt.date(2024, 1, 3), 20.0, 0.02, 1.0, 1.5),
    ]
    assert [r["note"] for r in rows] == ["hello", "a,b", None, None]
    nav = {(r["run_id"], r["date"].day): r["nav"] for r in reports.nav_drawdown(tables.portfolio).collect()}
    assert nav == {("run a", 2): 1.4, ("run a", 3): 1.5, ("b+%&c", 2): 1.0, ("b+%&c", 3): pytest.approx(0.99)}


def test_other_tables(spark, tree):
    tables = load_runs(spark, str(tree))
    assert tables.symbol.first()["date"] == dt.date(2024, 1, 2)
    assert reports.roundtrips(tables.trades).first()["gross_pnl"] == 8.0
    signal = tables.signals.first()
    assert signal["tradingday"] is None and signal["action_datetime"] == dt.datetime(2024, 1, 2, 8, 59)
    assert signal["bar_oi"] is None
    assert {r["tradingday"] for r in tables.rolls.collect()} == {dt.date(2024, 1, 3), None}
    assert tables.summary.first().asDict() == {"run_id": "run a", "label": "total", "sharpe": 1.5}
    assert tables.capital_curves.count() == 0


def test_named_runs_only(spark, tree):
    assert {r["run_id"] for r in load_runs(spark, str(tree), ["b+%&c"]).portfolio.collect()} == {"b+%&c"}
    with pytest.raises(FileNotFoundError):
        load_runs(spark, str(tree), ["absent"])


def test_unreadable_date_fails(spark, tmp_path):
    put(tmp_path / "r/daily/portfolio/daily_pnl_portfolio_1.csv", "date,daily_pnl\nsoon,1\n")
    with pytest.raises(Exception, match="not a date or time"):
        load_runs(spark, str(tmp_path)).portfolio.collect()


def test_equity_runs(spark, tmp_path):
    put(tmp_path / "demo/capital_curves.csv", "date,q5,q1\n2025-01-31,10000,9800\n2025-02-28,10200,9900\n2025-03-31,10100,9700\n")
    put(tmp_path / "demo/ic_summary.csv", "factor,ic_mean\nbook,0.07\n")
    put(tmp_path / "other/capital_curves.csv", "ols,date\n10000,2025-01-31\n,2025-02-28\n10300,2025-03-31\n")
    put(tmp_path / "other/ic_summary.csv", "name,ignored,value\nskew_5d,x,-0.02\n")
    put(tmp_path / "bare/synthesis_comparison_summary.csv", "method,n,score\nrank,1,0.5\n")
    tables = load_equity_runs(spark, str(tmp_path))

    rows = {(r["run_id"], r["date"].month): r for r in tables.portfolio.collect()}
    demo = [rows["demo", m] for m in (1, 2, 3)]
    assert [r["net_value"] for r in demo] == pytest.approx([1.0, 1.02, 1.01])
    assert [r["daily_pnl"] for r in demo] == [0.0, 200.0, -100.0]
    assert [r["daily_pnl_pct"] for r in demo] == pytest.approx([0.0, 0.02, -0.01])
    # A gap makes two zero steps and loses the move across it.
    assert [rows["other", m]["daily_pnl"] for m in (1, 2, 3)] == [0.0, 0.0, 0.0]

    built = reports.build_reports(tables, "equity", "equity")
    assert {(r["run_id"], r["factor"], r["ic_mean"]) for r in built["factor_ic"].collect()} == {
        ("demo", "book", 0.07),
        ("other", "skew_5d", -0.02),
    }
    assert [r["spread"] for r in built["quantile_spread"].orderBy("date").collect()] == [200.0, 300.0, 400.0]
    assert [tuple(r) for r in built["synthesis_fallback"].collect()] == [("bare", "rank", 0.5)]

    named = load_equity_runs(spark, str(tmp_path), ["demo"], strategy="q1").portfolio
    assert {r["strategy"] for r in named.collect()} == {"q1"}
    as_root = load_equity_runs(spark, str(tmp_path / "demo"), ["absent"])
    assert {r["run_id"] for r in as_root.portfolio.collect()} == {"demo"}


def test_bars(spark, tmp_path):
    inner = tmp_path / "MarketData"
    put(inner / "2020/a/a/A2105&B2102.csv", "datetime,close\n2020-01-02 09:00:00,1\n2020-01-02 09:01:00,bad\n", "utf-8-sig")
    put(inner / "2020/a/A2105&B2102.csv", "datetime,close\n2020-01-02 09:00:00,-1\n")
    put(tmp_path / "2021/A&B/A2105&B2102.csv", "close_price,datetime,close\n7,2021-01-04 09:00:00,8\n1.0d,2021-01-04 09:01:00,8\n")
    put(tmp_path / "2020/C&D/C1&D1.csv", "datetime,close\n2020-01-02 09:00:00,3\n")
    put(tmp_path / "2020/wrong/E1&F1.csv", "datetime,close\n2020-01-02 09:00:00,4\n")
    put(tmp_path / "2020/G&H/G1&H1.csv", "datetime,price\n2020-01-02 09:00:00,4\n")
    rows = [tuple(r)[:3] for r in load_bars(spark, str(tmp_path), ["2020", "2021"]).orderBy("spread", "datetime").collect()]
    # The 2021 file has close_price, so the 2020 closes of that spread do not count.
    assert rows == [
        ("A2105&B2102", dt.datetime(2021, 1, 4, 9), 7.0),
        ("C1&D1", dt.datetime(2020, 1, 2, 9), 3.0),
    ]
    only = load_bars(spark, str(tmp_path), [2020], ["A2105&B2102"]).collect()
    assert [r["close"] for r in only] == [1.0]
    assert load_bars(spark, str(tmp_path), ["1999"]).count() == 0


def test_sink(spark, tree, tmp_path):
    tables = load_runs(spark, str(tree))
    target = str(tmp_path / "out")
    write_report(reports.nav_drawdown(tables.portfolio), f"{target}/nav")
    assert spark.read.parquet(f"{target}/nav").count() == 4
    built = reports.build_reports(tables, "common")
    assert len(write_reports(built, target)) == len(built)
    back = spark.read.parquet(f"{target}/monthly_returns")
    assert {(r["run_id"], r["label"]) for r in back.collect()} == {("run a", "2024-01"), ("b+%&c", "2024-01")}


def test_staged_tables_read_the_same(spark, tree, tmp_path):
    tables = load_runs(spark, str(tree))
    staged = stage_tables(tables, str(tmp_path / "staged"))
    for name in ("portfolio", "trades", "rolls", "capital_curves"):
        before, after = getattr(tables, name), getattr(staged, name)
        columns = sorted(set(before.columns) - {"row_id"})
        assert after.schema.simpleString() and set(after.columns) == set(before.columns)
        assert sorted(map(str, after.select(columns).collect())) == sorted(map(str, before.select(columns).collect()))


def test_one_run_is_rewritten_alone_and_sorted(spark, tmp_path):
    path = f"{tmp_path}/nav"
    rows = lambda run, n: spark.range(n).selectExpr(f"'{run}' as run_id", "date_add(date'2024-01-01', cast((id * 7) % n as int)) as date".replace("% n", f"% {n}"), "id as nav")
    write_report(rows("a", 11).union(rows("b", 5)), path)
    write_report(rows("a", 3), path)
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert counts == {"a": 3, "b": 5}
    clear_report(rows("c", 4), path)
    assert [r["run_id"] for r in spark.read.parquet(path).select("run_id").distinct().collect()] == ["c"]
    files = {r["f"] for r in spark.read.parquet(path).selectExpr("input_file_name() as f").collect()}
    for name in files:
        dates = [r["date"] for r in spark.read.parquet(name).collect()]
        assert dates == sorted(dates)


def test_row_with_more_cells_than_the_header_fails(spark, tmp_path):
    put(tmp_path / "r/rolls/roll_events.csv", 'tradingday,x\n2024-01-03,"a,b"\n2024-01-04\n')
    assert load_runs(spark, str(tmp_path)).rolls.count() == 2
    put(tmp_path / "s/rolls/roll_events.csv", "tradingday,x\n2024-01-03,1,2,3\n")
    with pytest.raises(Exception, match="more cells than the header"):
        load_runs(spark, str(tmp_path)).rolls.count()


def test_many_headers_are_one_plan(spark, tmp_path):
    for i in range(200):
        put(tmp_path / f"run{i:03d}/capital_curves.csv", f'"s,{i}",date,t{i}\n{i},2024-01-02,NA\n{i + 1},2024-01-03,5\n', "utf-8-sig")
    put(tmp_path / "undated/capital_curves.csv", "a,b\n1,2\n")
    curves = load_equity_runs(spark, str(tmp_path)).capital_curves
    plan = curves._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 4  # whole records and those of several lines, each with its headers
    rows = {(r["run_id"], r["date"].day, r["col_pos"]): (r["strategy"], r["capital"]) for r in curves.collect()}
    assert len(rows) == 800 and rows["run007", 2, 0] == ("s,7", 7.0) and rows["run199", 3, 1] == ("t199", 5.0)
    assert rows["run000", 2, 1] == ("t0", None)


def test_typed_tables_of_many_headers_are_one_plan(spark, tmp_path):
    for i in range(1000):
        extra = f",{'x' * (i % 7 + 1)}" if i % 2 else ""
        names, cells = (f"date,daily_pnl{extra}", f"2024-01-02,{i}") if i % 3 else (f"日盈亏,日期{extra}", f"{i},20240102")
        put(tmp_path / f"r{i:04d}/daily/portfolio/daily_pnl_portfolio_1.csv", f"{names}\n{cells}{',7' if i % 2 else ''}\n")
    portfolio = load_runs(spark, str(tmp_path)).portfolio
    assert portfolio._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 4
    assert dict(portfolio.dtypes)["xxx"] == "bigint"
    rows = {r["run_id"]: r for r in portfolio.collect()}
    assert len(rows) == 1000 and all(rows[f"r{i:04d}"]["daily_pnl"] == i for i in range(1000))
    assert {r["date"] for r in rows.values()} == {dt.date(2024, 1, 2)} and rows["r0001"]["xx"] == 7 and rows["r0002"]["xx"] is None


def test_line_breaks_in_cells_and_row_ids_do_not_depend_on_the_split(spark, tmp_path):
    """Cells with line breaks, doubled quotes and commas; inches in plain cells are text."""
    lines, expected = ["tradingday,note,n"], []
    for i in range(120):
        note = ["plain", "two\nlines", 'say ""x"", then\n\nstop', "a,b", 'a""\nb""'][i % 5]
        cell = f'"{note}"' if i % 5 else (f'{i}" pipe' if i % 10 else "plain")
        lines += [f"2024-01-02,{cell},{i}", ""]
        expected.append((i, cell[1:-1].replace('""', '"') if i % 5 else cell))
    put(tmp_path / "r/rolls/roll_events.csv", "\n".join(lines) + "\n")
    put(tmp_path / "r/trades/trades.csv", "\n".join(["价差合约,成交价", *[f"A&B,{i}" for i in range(300)]]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found, ids = [], []
    try:
        for split in ("97b", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            tables = load_trades(spark, str(tmp_path), ["r"]), load_rolls(spark, str(tmp_path), ["r"])
            pieces = spark.read.text(str(tmp_path / "r/trades")).rdd.getNumPartitions()
            assert (pieces > 10) == (split == "97b")
            ids.append(sorted((r["row_id"], r["price"]) for r in tables[0].collect()))
            found.append(sorted((r["n"], r["note"]) for r in tables[1].collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found == [expected, expected]
    assert ids[0] == ids[1] == [(i + 1, float(i)) for i in range(300)]


def test_open_quote_fails(spark, tmp_path):
    put(tmp_path / "r/rolls/roll_events.csv", 'tradingday,x\n2024-01-03,"a\n2024-01-04,b\n')
    with pytest.raises(Exception, match="not closed"):
        load_rolls(spark, str(tmp_path), ["r"]).collect()


def test_other_columns_get_the_narrowest_type(spark, tmp_path):
    put(tmp_path / "a/performance/summary.csv", "k,n,x,day,word,none\np,1,1,2024-01-02,7,\nq,NA,2.5,2024-01-03,x,nan\n")
    put(tmp_path / "b/performance/summary.csv", "n,k\ntotal,3\n")
    summary = load_summary(spark, str(tmp_path), ["a", "b"])
    assert dict(summary.dtypes) == {
        "run_id": "string", "label": "string", "k": "bigint", "n": "bigint", "x": "double", "day": "date", "word": "string", "none": "string",
    }
    rows = {r["label"]: r for r in summary.collect()}
    assert rows["total"]["k"] == 3 and rows["total"]["n"] is None and rows["p"]["n"] == 1 and rows["p"]["k"] is None
    assert rows["q"]["x"] == 2.5 and rows["q"]["day"] == dt.date(2024, 1, 3) and rows["q"]["word"] == "x"


def test_run_computed_to_no_rows_is_emptied(spark, tmp_path):
    path = f"{tmp_path}/x"
    rows = lambda run: spark.range(3).selectExpr(f"'{run}' as run_id", "id")
    write_report(rows("a b%").union(rows("b")).union(rows("c")), path)
    write_report(rows("b"), path, runs=["a b%", "b", "new"])
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()}
    assert counts == {"b": 3, "c": 3}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_conditions_on_numbers_meet_no_headers_or_parts_of_records(spark, tmp_path, broadcast):
    """Spark moves a reader's conditions into the join with the headers; there they must not see what is no record."""
    names = "date,daily_pnl,daily_pnl_pct,note"
    put(tmp_path / "a/daily/portfolio/daily_pnl_portfolio_1.csv", f'{names}\n2024-01-02,5,0.5,x\n\n2024-01-03,6,NA,"1\n2,y,z,x,w,u\n3"\n')
    put(tmp_path / "b/daily/portfolio/daily_pnl_portfolio_1.csv", "日盈亏,日期,日收益率\n7,20240102,-0.5\n")
    limits = {c: spark.conf.get(c, None) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for name in limits:
            spark.conf.set(name, broadcast)
        portfolio = load_runs(spark, str(tmp_path)).portfolio
        held = portfolio.where("abs(daily_pnl_pct) > 0 and not isnan(daily_pnl_pct) and date < '2024-02-01'").collect()
        assert {(r["run_id"], r["daily_pnl"], r["daily_pnl_pct"]) for r in held} == {("a", 5.0, 0.5), ("b", 7.0, -0.5)}
        joined = portfolio.where("abs(daily_pnl) between 6 and 9 and date < '2024-02-01'").collect()
        assert {(r["daily_pnl"], r["note"]) for r in joined} == {(6.0, "1\n2,y,z,x,w,u\n3"), (7.0, None)}
    finally:
        for name, value in limits.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
