"""Long series cut into blocks give the same results as whole ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratlens.operators import ordered, rolling, trades

KEYS, ORDER = ["k"], ["datetime", "row_id"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    start = datetime(2023, 11, 1)
    data = []
    for i in range(3000):
        # Key "hot" holds most rows and a third of them share one instant.
        key = "hot" if rng.random() < 0.8 else rng.choice("abc")
        same = key == "hot" and rng.random() < 0.4
        time = datetime(2024, 2, 2) if same else start + timedelta(minutes=rng.randrange(180 * 24 * 60))
        if rng.random() < 0.05:
            time = None
        value = None if rng.random() < 0.03 else round(100 + rng.gauss(0, 3), 2)
        data.append((key, time, value, i))
    df = spark.createDataFrame(data, "k string, datetime timestamp_ntz, x double, row_id bigint")
    return df.repartition(4).cache()


def blocks(df, how):
    if how == "none":
        return df, None
    if how.startswith("range"):
        return ordered.range_blocks(df, KEYS, ORDER, "month", int(how[5:])), ordered.BLOCK
    return ordered.calendar_blocks(df, ORDER, how), ordered.BLOCK


@pytest.mark.parametrize("salts", [1, 5])
def test_hot_month_is_several_pieces(rows, spark, salts):
    """Most rows have one key, two fifths of these one instant, and some no time: all are cut, in the rows' order."""
    spark.conf.set("spark.sql.shuffle.partitions", str(salts))
    try:
        cut = ordered.range_blocks(rows, KEYS, ORDER, "month", 50).collect()
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")
    assert len(cut) == rows.count()
    for kind in (lambda r: r["datetime"] == datetime(2024, 2, 2), lambda r: r["datetime"] is None, lambda r: True):
        hot = [r[ordered.BLOCK] for r in cut if r["k"] == "hot" and kind(r)]
        sizes = {b: hot.count(b) for b in set(hot)}
        assert len(sizes) > 1 and max(sizes.values()) < 500
    series = sorted((r for r in cut if r["k"] == "hot"), key=time_of)
    assert [tuple(r[ordered.BLOCK]) for r in series] == sorted(tuple(r[ordered.BLOCK]) for r in series)


def test_hot_month_is_dealt_over_tasks(rows, spark):
    cut = ordered.range_blocks(rows.where("k = 'hot'"), KEYS, ORDER, "year", 20)
    summed = ordered.cumulative(cut, KEYS, ORDER, {"s": ("sum", F.col("x"))}, ordered.BLOCK)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in summed.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 2


def collected(df, *names):
    return sorted((tuple(r[n] for n in ("row_id", *names)) for r in df.collect()), key=lambda t: t[0])


@pytest.mark.parametrize("how", ["year", "month", "day", "range40"])
def test_running_totals(rows, how):
    outputs = {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}
    whole = collected(ordered.cumulative(rows, KEYS, ORDER, outputs), "s", "m")
    cut, block = blocks(rows, how)
    pieces = collected(ordered.cumulative(cut, KEYS, ORDER, outputs, block), "s", "m")
    for (i, s, m), (j, t, n) in zip(whole, pieces, strict=True):
        assert i == j and m == n and (s == t or s == pytest.approx(t))


@pytest.mark.parametrize("how", ["year", "month", "day", "range40"])
def test_previous_and_position(rows, how):
    cut, block = blocks(rows, how)
    value = F.struct("row_id", "x")
    whole = ordered.position(ordered.previous(rows, KEYS, ORDER, value, "p"), KEYS, ORDER)
    pieces = ordered.position(ordered.previous(cut, KEYS, ORDER, value, "p", block), KEYS, ORDER, "pos", block)
    assert collected(whole, "p", "pos") == collected(pieces, "p", "pos")


def model_zscore(data, window):
    out = {}
    for key in {r["k"] for r in data}:
        series = sorted((r for r in data if r["k"] == key), key=time_of)
        for i, r in enumerate(series):
            xs = [s["x"] for s in series[max(0, i - window + 1) : i + 1]]
            out[r["row_id"]] = None
            if len(xs) == window and None not in xs:
                mean = sum(xs) / window
                var = sum((x - mean) ** 2 for x in xs) / (window - 1)
                if var > 0:
                    out[r["row_id"]] = (xs[-1] - mean) / var**0.5
    return out


@pytest.mark.parametrize("how", ["none", "day", "range30"])
@pytest.mark.parametrize("length", [5, 64, 4096])
def test_zscore_against_loop(rows, how, length, monkeypatch):
    window = 12
    short = ordered.segments

    def cut_short(df, keys, order, reach, block=None):
        return short(df, keys, order, reach, block, length)

    monkeypatch.setattr(rolling, "segments", cut_short)
    cut, block = blocks(rows, how)
    got = dict(collected(rolling.zscore(cut, window, KEYS, ORDER, "x", block), "z"))
    expected = model_zscore(rows.collect(), window)
    assert set(got) == set(expected)
    for key, value in expected.items():
        assert (got[key] is None) == (value is None), key
        if value is not None:
            assert got[key] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("window", [1, 2, 3, 7, 64, 100])
def test_window_drawdown_against_loop(spark, window, monkeypatch):
    """Windows that are one power of two, or several, over segments shorter and longer than they are; with a missing value."""
    rng = random.Random(window)
    values = [None if k == 150 else 1 + rng.gauss(0, 0.1) for k in range(400)]
    days = [(datetime(2020, 1, 1) + timedelta(days=k)).date() for k in range(400)]
    df = spark.createDataFrame([("r", d, v) for d, v in zip(days, values, strict=True)], "run_id string, date date, nav double")
    short = ordered.segments
    monkeypatch.setattr(rolling, "segments", lambda df, keys, order, reach, block=None: short(df, keys, order, reach, block, 90))
    got = {r["date"]: r["max_drawdown"] for r in rolling.rolling_max_drawdown(df, window).collect()}
    for k, day in enumerate(days):
        part = values[max(0, k - window + 1) : k + 1]
        expected = None
        if len(part) == window and None not in part:
            expected = min(v - max(part[: j + 1]) for j, v in enumerate(part))
        assert got[day] == expected, k


def test_constant_window_has_no_zscore(spark):
    values = [0.1] * 6 + [0.3] + [0.7] * 6
    df = spark.createDataFrame([("s", datetime(2024, 1, 1, 0, i), v, i) for i, v in enumerate(values)], "spread string, datetime timestamp_ntz, close double, row_id bigint")
    z = [r["z"] for r in rolling.zscore(df, 5).orderBy("row_id").collect()]
    assert [v is None for v in z] == [True] * 6 + [False] * 5 + [True] * 2


def last_of_side(fills, close, side):
    """The fill before a close that is an open of that side or a close of it, whichever is later."""
    series = [f for f in fills if (f["instance_id"], f["spread"]) == (close["instance_id"], close["spread"])]
    earlier = [f for f in series if time_of(f) < time_of(close) and side_of(f) == side]
    return max(earlier, key=time_of, default=None)


def time_of(f):
    return f["datetime"] is None, f["datetime"] or datetime.min, f["row_id"]


def is_open(f):
    return (f["offset"] or "").upper() == "OPEN"


def side_of(f):
    direction = (f["direction"] or "nan").upper()
    if is_open(f):
        return direction
    return "LONG" if direction == "SHORT" else "SHORT"


def model_pairs(fills):
    """For every close, look back for the last fill of its side; an open there makes a trade."""
    known = [f for f in fills if f["instance_id"] is not None and f["spread"] is not None]
    trades_made = []
    for close in (f for f in known if not is_open(f)):
        side = side_of(close)
        entry = last_of_side(known, close, side)
        if entry is None or not is_open(entry):
            continue
        move = close["price"] - entry["price"] if side == "LONG" else entry["price"] - close["price"]
        profit = move * entry["volume"] - entry["commission"] - close["commission"]
        trades_made.append((close["row_id"], entry["datetime"], side, entry["price"], close["price"], entry["volume"], round(profit, 6)))
    return trades_made


@pytest.mark.parametrize("how", ["none", "year", "hour", "range"])
def test_roundtrips_against_slots(spark, how):
    rng = random.Random(11)
    data = []
    for i in range(1500):
        instance = "hot" if rng.random() < 0.7 else rng.choice(["s1", "s2", None])
        time = datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(4000)) if rng.random() < 0.7 else datetime(2024, 1, 2)
        if rng.random() < 0.1:
            time = None
        data.append(
            (
                "r", instance, rng.choice(["A&B", "A&B", "C&D", None]), time,
                rng.choice(["LONG", "short", "BUY", None]), rng.choice(["OPEN", "open", "CLOSE", "CLOSETODAY", None]),
                float(rng.randrange(90, 110)), rng.randrange(1, 5), float(rng.randrange(3)), i,
            )
        )
    schema = "run_id string, instance_id string, spread string, datetime timestamp_ntz, direction string, offset string, price double, volume int, commission double, row_id bigint"
    fills = spark.createDataFrame(data, schema)
    if how == "range":
        cut, block = ordered.range_blocks(fills, trades.SERIES, trades.FILL_ORDER, "year", 25), ordered.BLOCK
    else:
        cut, block = blocks(fills, how)
    matched = trades.pair_roundtrips(cut, block)
    got = [
        (r["direction"], r["open_time"], r["close_time"], r["open_price"], r["close_price"], r["volume"], round(r["gross_pnl"], 6))
        for r in matched.collect()
    ]
    times = {d[9]: d[3] for d in data}
    expected = [(side, opened, times[i], a, b, v, p) for i, opened, side, a, b, v, p in model_pairs([r.asDict() for r in fills.collect()])]
    assert sorted(got, key=repr) == sorted(expected, key=repr) and len(got) > 100
    assert matched.filter("holding_minutes < 0").count() == 0


def test_reports_agree_on_long_daily_series(spark):
    from stratlens.plans import reports
    from stratlens.sources.tables import RunTables

    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        run = "big" if i % 6 else "small"
        date = (start + timedelta(days=rng.randrange(90))).date() if i % 3 else start.date()
        rows.append((run, date, rng.choice("ABC"), float(rng.randrange(-5, 6)), round(rng.gauss(0, 0.01), 6), 1.0, i))
    schema = "run_id string, date date, spread string, daily_pnl double, daily_pnl_pct double, commission double, row_id bigint"
    daily = spark.createDataFrame(rows, schema).withColumn("num_trades", F.lit(1)).withColumn("num_spreads", F.lit(1))
    rolls = spark.createDataFrame([("big", start.date())], "run_id string, tradingday date")
    tables = RunTables.of(spark, portfolio=daily, symbol=daily, rolls=rolls)
    cut = reports.cut_daily(tables, "month")
    assert cut.portfolio_block and cut.symbol_block
    options = reports.Options(rolling_windows=(5, 9))
    for report in ("01", "03", "04", "11", "13", "14"):
        whole, pieces = reports.REPORTS[report](tables, options), reports.REPORTS[report](cut, options)
        for name in whole:
            left, right = (
                sorted(str([round(v, 6) + 0.0 if isinstance(v, float) else v for v in r]) for r in d[name].collect())
                for d in (whole, pieces)
            )
            assert left == right, name
