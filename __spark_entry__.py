"""Registered queries and the SQL each one is checked against.

Both sides read the same raw tables. Amounts are rounded in the last projection only; adding 0.0
turns a rounded minus zero into zero on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlens.fixtures import STRATEGIES, FixtureTables, raw, view, with_views
from stratlens.functions import columns
from stratlens.operators import compare, factors, returns, rolling, signals, trades, universe
from stratlens.operators.ordered import BLOCK, range_blocks
from stratlens.plans import reports
from stratlens.schemas import PORTFOLIO, PORTFOLIO_HEADERS
from stratlens.sources.runs import normalize

try:  # a checkout may come without the training-data operators and their pipeline
    from stratlens.llm import queries as llm
except ModuleNotFoundError:
    llm = None
try:
    import corpus_pipeline
except ModuleNotFoundError:
    corpus_pipeline = None

# Twenty bars instead of the usual 300, which no spread has at the small scale factors; zscore_default has 300.
BAR_OPTIONS = reports.Options(lookback=20)

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({name: F.round(F.col(name).cast("double"), n) + F.lit(0.0) for name, n in digits.items()})


def _on_tables(build: Callable[[FixtureTables], DataFrame], **digits: int) -> Query:
    return lambda spark, sf_dir: _rounded(build(FixtureTables(spark, sf_dir)), **digits)


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_bars")


def _bar_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_symbol_events")


def _zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = range_blocks(_bars(spark, sf_dir), ["spread"], ["datetime", "row_id"], BAR_OPTIONS.bar_unit)
    return _rounded(rolling.zscore(cut, BAR_OPTIONS.lookback, block=BLOCK).drop(BLOCK), z=6)


def _zscore_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usual look-back, over contracts instead of spreads: these have enough bars at the small scale factors."""
    bars = view(spark, sf_dir, "fx_contract_bars")
    cut = range_blocks(bars, ["spread"], ["datetime", "row_id"], BAR_OPTIONS.bar_unit)
    return _rounded(rolling.zscore(cut, reports.Options.lookback, block=BLOCK).drop(BLOCK), z=6)


def _zscore_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = reports.diagnostic_bars(_bar_symbol(spark, sf_dir), _bars(spark, sf_dir), BAR_OPTIONS)
    return _rounded(built, z=6)


def _zscore_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = FixtureTables(spark, sf_dir)
    return reports.diagnostic_events(_bar_symbol(spark, sf_dir), tables.signals, tables.trades, _bars(spark, sf_dir), BAR_OPTIONS)


def _diagnostic_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = universe.spread_totals(_bar_symbol(spark, sf_dir))
    return _rounded(universe.diagnostic_spreads(totals), pnl=4)


def _spread_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "fx_symbol").select("spread").union(view(spark, sf_dir, "fx_bars").select("spread"))
    part = raw(spark, sf_dir, "part")
    names = names.union(part.select(F.col("p_partkey").cast("string"))).union(part.select("p_brand")).distinct()
    return names.select(
        "spread",
        columns.product_prefix("spread").alias("prefix"),
        columns.spread_product("spread").alias("product"),
        columns.spread_pair_folder("spread").alias("folder"),
    )


def _lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = raw(spark, sf_dir, "events").select("event_id", "value", "props")
    kind, text = F.col("event_id") % 5, F.format_string("%.2f", "value")
    written = (
        F.when(kind == 0, F.concat(text, F.lit("d")))
        .when(kind == 1, F.concat(F.lit(" "), text))
        .when(kind == 2, F.col("props"))
        .when(kind == 3, F.concat(text, F.lit("e1")))
        .otherwise(text)
    )
    return events.select("event_id", F.round(columns.lenient_double(written), 4).alias("number"))


def _totals(t: FixtureTables) -> DataFrame:
    return universe.spread_totals(t.symbol)


def _drawdown_relative(t: FixtureTables) -> DataFrame:
    return returns.drawdown_relative(returns.portfolio_nav(t.portfolio)).select("run_id", "date", "drawdown")


def _rolling_sharpe(t: FixtureTables) -> DataFrame:
    return rolling.rolling_sharpe(t.portfolio, 60).select("run_id", "date", "sharpe")


def _rolling_max_drawdown(t: FixtureTables) -> DataFrame:
    priced = returns.portfolio_nav(t.portfolio)
    return rolling.rolling_max_drawdown(priced, 60).select("run_id", "date", "max_drawdown")


def _hist(t: DataFrame, value: str) -> DataFrame:
    return trades.histogram(t, value)


def _density(t: DataFrame, value: str) -> DataFrame:
    return trades.density(t, value)


def _first_capital(t: FixtureTables) -> DataFrame:
    return returns.capital_to_portfolio(returns.first_strategy(t.capital_curves))


def _localised_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns under localised headers, one layout per half of the runs' dates, read back."""
    source = FixtureTables(spark, sf_dir).portfolio
    names = {english: local for local, english in PORTFOLIO_HEADERS.items() if english in source.columns}
    text = source.select("run_id", *[F.col(c).cast("string").alias(local) for c, local in names.items()])
    early = text.filter(F.col("日期") < "1998-01-01")
    late = text.filter(F.col("日期") >= "1998-01-01").withColumn("日期", F.replace(F.col("日期"), F.lit("-"), F.lit("")))
    both = early.unionByName(late.drop("套利对数"), allowMissingColumns=True)
    read = normalize(both, PORTFOLIO_HEADERS, PORTFOLIO)
    kept = read.select("run_id", "date", "daily_pnl", "daily_pnl_pct", "num_trades", "num_spreads")
    return _rounded(kept, daily_pnl=4, daily_pnl_pct=8)


def queries() -> dict[str, Query]:
    more = llm.queries() if llm else {}
    return analytics() | more | ({"pipeline": corpus_pipeline.run} if corpus_pipeline else {})


def analytics() -> dict[str, Query]:
    r, u, on = reports, universe, _on_tables
    return {
        # portfolio
        # Gross profit nearly cancels out in this data, so the ratio carries few exact digits.
        "run_scorecard": on(lambda t: compare.run_scorecard(t.portfolio), comm_ratio=4),
        "nav_drawdown": on(lambda t: r.nav_drawdown(t.portfolio), nav=8, drawdown=8),
        "nav_drawdown_supplied": on(lambda t: r.nav_drawdown(_first_capital(t)), nav=8, drawdown=8),
        "drawdown_relative": on(_drawdown_relative, drawdown=8),
        "daily_pnl": on(lambda t: r.daily_pnl(t.portfolio), daily_pnl=4),
        "active_return_hist": on(lambda t: _hist(r.active_returns_pct(t.portfolio), "return_pct"), lo=8, hi=8),
        "active_return_density": on(
            lambda t: _density(r.active_returns_pct(t.portfolio), "return_pct"), x=8, density=6, curve=6
        ),
        "cost_curves": on(lambda t: r.cost_curves(t.portfolio), cum_gross=4, cum_net=4, cum_commission=4),
        "activity": on(lambda t: u.activity(t.portfolio, t.symbol)),
        "monthly_returns": on(lambda t: returns.monthly_returns(t.portfolio), ret=8),
        "annual_returns": on(lambda t: returns.annual_returns(t.portfolio), ret=8),
        "month_matrix": on(
            lambda t: returns.month_matrix(t.portfolio), **{f"m{m:02d}": 8 for m in range(1, 13)}
        ),
        "rolling_metrics": on(lambda t: r.rolling_metrics(t.portfolio, (60, 120)), sharpe=6, max_drawdown=8),
        "rolling_sharpe": on(_rolling_sharpe, sharpe=6),
        "rolling_max_drawdown": on(_rolling_max_drawdown, max_drawdown=8),
        # comparison of runs
        "run_radar": on(lambda t: compare.run_radar(compare.run_scorecard(t.portfolio)), value=6),
        "return_vs_drawdown": on(
            lambda t: compare.return_vs_drawdown(compare.run_scorecard(t.portfolio)),
            max_drawdown_pct=6,
            total_return_pct=6,
        ),
        "multi_nav": on(lambda t: compare.multi_nav(t.portfolio), nav=8),
        # trades
        "roundtrips": on(
            lambda t: r.roundtrips(t.trades),
            open_price=4,
            close_price=4,
            commission=4,
            gross_pnl=4,
            holding_minutes=8,
        ),
        "roundtrip_pnl_hist": on(lambda t: _hist(r.roundtrips(t.trades), "gross_pnl"), lo=6, hi=6),
        "roundtrip_pnl_density": on(
            lambda t: _density(r.roundtrips(t.trades), "gross_pnl"), x=6, density=8, curve=6
        ),
        "holding_hours_hist": on(lambda t: trades.histogram(r.holding_hours(r.roundtrips(t.trades)), "hours", above=0.0), lo=6, hi=6),
        "holding_hours_density": on(
            lambda t: trades.density(r.holding_hours(r.roundtrips(t.trades)), "hours", above=0.0), x=6, density=8, curve=6
        ),
        # signals and rolls
        "signal_fill_daily": on(lambda t: signals.signal_fill_daily(t.signals, t.trades), conversion=8),
        "signal_fill_monthly": on(
            lambda t: signals.signal_fill_monthly(signals.signal_fill_daily(t.signals, t.trades)), conversion=8
        ),
        "open_signal_oi": on(lambda t: signals.open_signal_oi(t.signals), bar_oi=4, price=4),
        "signal_day_coverage": on(lambda t: signals.signal_day_coverage(t.signals, t.trades)),
        "roll_events": on(lambda t: signals.roll_events(t.portfolio, t.rolls), nav=8),
        "roll_dates": on(lambda t: signals.roll_dates(t.rolls)),
        # universe
        "spread_cumulative_pnl": on(lambda t: u.spread_cumulative_pnl(t.symbol), pnl=4),
        "spread_nav": on(
            lambda t: u.spread_nav(t.symbol).select("run_id", "spread", "date", "nav"), nav=8
        ),
        "spread_nav_picks": on(lambda t: u.spread_nav_picks(t.symbol, t.portfolio), nav=8),
        "spread_month_matrix": on(lambda t: u.spread_month_matrix(t.symbol), ret=8),
        "spread_contribution": on(lambda t: u.spread_contribution(t.symbol, t.trades), pnl=4, commission=4),
        "top_bottom_spreads": on(lambda t: u.top_bottom_spreads(_totals(t)), pnl=4),
        "diagnostic_spreads": _diagnostic_spreads,
        "largest_spreads": on(
            lambda t: u.largest_spreads(_totals(t)).select("run_id", "spread", "pnl", "rank"), pnl=4
        ),
        "active_spreads": on(
            lambda t: u.active_spreads(_totals(t)).select("run_id", "spread", "active_pnl", "rank"), active_pnl=4
        ),
        "active_spreads_per_day": on(lambda t: u.active_spreads_per_day(t.symbol)),
        "active_spread_count": on(lambda t: u.active_spread_count(t.symbol)),
        "spread_correlation": on(lambda t: u.spread_correlation(t.symbol), corr=6),
        "sector_pnl": on(lambda t: u.sector_pnl(t.symbol), pnl=4),
        "sector_daily_pnl": on(lambda t: u.sector_daily_pnl(t.symbol), pnl=4),
        "sector_box": on(lambda t: u.sector_box(t.symbol), q1=6, med=6, q3=6, whislo=6, whishi=6),
        # bars
        "zscore": _zscore,
        "zscore_default": _zscore_default,
        "zscore_bars": _zscore_bars,
        "zscore_events": _zscore_events,
        # factors and capital curves
        "factor_ic": on(lambda t: factors.factor_ic(t.ic_summary)),
        "synthesis_curves": on(lambda t: factors.capital_curves(t.capital_curves), capital=2),
        "synthesis_fallback": on(
            lambda t: factors.synthesis_fallback(t.capital_curves, t.synthesis_summary), value=2
        ),
        "quantile_spread": on(lambda t: factors.quantile_spread(t.capital_curves), spread=2),
        "capital_to_portfolio": on(
            lambda t: returns.capital_to_portfolio(t.capital_curves),
            net_value=8,
            daily_pnl=4,
            daily_pnl_pct=8,
        ),
        "first_strategy_portfolio": on(_first_capital, net_value=8, daily_pnl=4, daily_pnl_pct=8),
        # names and numbers
        "spread_names": _spread_names,
        "lenient_numbers": _lenient_numbers,
        "localised_portfolio": _localised_portfolio,
    }


def entry(spark: SparkSession) -> DataFrame:
    """The scorecard of every run."""
    return queries()["run_scorecard"](spark, "/root/testdata/sf0.001")


# --- checking SQL ------------------------------------------------------------
BY_RUN = "(partition by run_id order by date)"

NAV = f"nav as (select run_id, date, daily_pnl_pct, 1 + sum(daily_pnl_pct) over {BY_RUN} as nav from fx_portfolio)"

SCORECARD = f"""
cum as (select *, sum(daily_pnl_pct) over {BY_RUN} as c from fx_portfolio),
dd as (select *, c - max(c) over {BY_RUN} as d from cum),
score as (
  select run_id, count(*) as days, cast(count(*) filter (daily_pnl_pct <> 0) as bigint) as active_days,
    round_even(sum(daily_pnl_pct), 6) as total_return,
    round_even(sum(daily_pnl_pct) / count(*) * 244, 6) as annual_return,
    round_even(coalesce(avg(daily_pnl_pct) / nullif(stddev_samp(daily_pnl_pct), 0), 0) * sqrt(244), 4) as sharpe,
    round_even(min(d), 6) as max_drawdown,
    round_even(sum(daily_pnl_pct) / count(*) * 244 / nullif(abs(min(d)), 0), 4) as calmar,
    round_even(coalesce(count(*) filter (daily_pnl_pct > 0) / nullif(count(*) filter (daily_pnl_pct <> 0), 0), 0), 4) as win_rate,
    sum(commission) / greatest(abs(sum(daily_pnl) + sum(commission)), 1) as comm_ratio
  from dd group by run_id)"""

ROUNDTRIPS = """
sided as (
  select *, offset_ = 'OPEN' as opens,
    case when offset_ = 'OPEN' then direction when direction = 'SHORT' then 'LONG' else 'SHORT' end as side
  from fx_trades where instance_id is not null),
paired as (
  select *, lag(opens) over w as o_opens, lag(datetime) over w as open_time, lag(price) over w as open_price,
    lag(volume) over w as o_volume, lag(commission) over w as o_commission
  from sided window w as (partition by run_id, instance_id, spread, side order by datetime, row_id)),
roundtrips as (
  select run_id, instance_id, spread, side as direction, open_time, datetime as close_time, open_price,
    price as close_price, o_volume as volume, o_commission + commission as commission,
    (case when side = 'LONG' then price - open_price else open_price - price end) * o_volume - o_commission - commission as gross_pnl,
    greatest(0.0, date_diff('microsecond', open_time, datetime) / 6e7) as holding_minutes
  from paired where not opens and o_opens),
hours as (
  select run_id, holding_minutes / 60 as hours from roundtrips
  where run_id in (select run_id from roundtrips group by run_id having max(holding_minutes) > 0))"""

ACTIVE = "active as (select run_id, daily_pnl_pct * 100 as return_pct from fx_portfolio where daily_pnl_pct <> 0)"

TOTALS = """
totals as (
  select run_id, spread, sum(daily_pnl) as pnl, sum(commission) as commission,
    sum(daily_pnl) filter (daily_pnl <> 0) as active_pnl, count(*) filter (daily_pnl <> 0) as active_rows
  from fx_symbol group by 1, 2)"""

PICKS_50 = """
picks as (
  select * from (
    select run_id, spread, active_pnl, row_number() over (partition by run_id order by abs(active_pnl) desc, spread) as rank
    from totals where active_rows > 0)
  where rank <= 50),
cells as (
  select run_id, date, spread, sum(daily_pnl_pct) as ret
  from fx_symbol join picks using (run_id, spread) group by 1, 2, 3)"""

SECTOR_DAILY = """
sector_daily as (
  select run_id, date, upper(regexp_replace(split_part(spread, '&', 1), '[^A-Za-z]', '', 'g')) as sector, sum(daily_pnl) as pnl
  from fx_symbol group by 1, 2, 3)"""

CURVES = """
curves as (
  select run_id, date, strategy, 5 - cast(substr(strategy, 2) as integer) as col_pos, capital
  from fx_capital unpivot (capital for strategy in (q5, q4, q3, q2, q1)))"""

DAILY_CONVERSION = """
s as (select run_id, cast(action_datetime as date) as date, count(*) as signals from fx_signals group by 1, 2),
f as (select run_id, cast(datetime as date) as date, count(*) as fills from fx_trades group by 1, 2),
daily as (
  select run_id, date, coalesce(signals, 0) as signals, coalesce(fills, 0) as fills,
    coalesce(fills / nullif(signals, 0), 0) as conversion
  from s full join f using (run_id, date))"""

DIAGNOSTIC = """
bar_totals as (select run_id, spread, sum(daily_pnl) as pnl from fx_symbol_events group by 1, 2),
ordered as (
  select *, row_number() over (partition by run_id order by pnl desc, spread) as place,
    count(*) over (partition by run_id) as spreads from bar_totals),
zeros as (select run_id, spread, row_number() over (partition by run_id order by spread) as place from bar_totals where pnl = 0),
chosen as (
  select run_id, spread, place as rank from ordered where place <= 5 or place > spreads - 5
  union all select run_id, spread, 1000000 + place from zeros where place <= 5),
diagnostic as (
  select run_id, spread, row_number() over (partition by run_id order by min(rank)) as pick from chosen group by 1, 2)"""

ZSCORE = """
scored as (
  select *, case when count(*) over w = 20 then (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0) end as z
  from fx_bars window w as (partition by spread order by datetime, row_id rows between 19 preceding and current row))"""

WINDOWS = """
placed as (select *, row_number() over (partition by run_id order by date) as pos from nav),
frames as (
  select a.run_id, a.date, w.n as n, b.pos, b.nav, b.daily_pnl_pct
  from placed a cross join (values (60), (120)) w(n)
  join placed b on a.run_id = b.run_id and b.pos > a.pos - w.n and b.pos <= a.pos),
dips as (select *, nav - max(nav) over (partition by run_id, date, n order by pos) as dip from frames),
measured as (
  select run_id, date, cast(n as integer) as "window",
    case when count(*) = n then avg(daily_pnl_pct) / nullif(stddev_samp(daily_pnl_pct), 0) * sqrt(244) end as sharpe,
    case when count(*) = n then min(dip) end as max_drawdown
  from dips group by run_id, date, n)"""


def _sql(views: str, parts: list[str], select: str) -> str:
    return ",\n".join([with_views(*views.split()), *parts]) + "\n" + select


def _round(**digits: int) -> str:
    return ", ".join(f"round({name}, {n}) + 0.0 as {name}" for name, n in digits.items())


def _hist_sql(views: str, parts: list[str], source: str, value: str, digits: int) -> str:
    """Counts by comparing every value with every bin's edges."""
    bins = f"""
lim as (
  select run_id, case when min({value}) = max({value}) then min({value}) - 0.5 else min({value}) end as a,
    case when min({value}) = max({value}) then max({value}) + 0.5 else max({value}) end as b
  from {source} group by 1),
edges as (
  select run_id, cast(i as integer) as bin, a + i * ((b - a) / 30) as lo, case when i = 29 then b else a + (i + 1) * ((b - a) / 30) end as hi
  from lim cross join generate_series(0, 29) g(i))"""
    select = f"""
select e.run_id, bin, {_round(lo=digits, hi=digits)}, count({value}) as n
from edges e left join {source} v on v.run_id = e.run_id and {value} >= lo and ({value} < hi or (bin = 29 and {value} <= hi))
group by e.run_id, bin, lo, hi"""
    return _sql(views, [*parts, bins], select)


def _density_sql(views: str, parts: list[str], source: str, value: str, x: int, density: int) -> str:
    """Every value's kernel at every grid point."""
    grid = f"""
shape as (
  select run_id, min({value}) as lo, (max({value}) - min({value})) / 199 as step, count(*) as n,
    stddev_samp({value}) * pow(count(*), -0.2) as h
  from {source} group by 1),
grid as (select *, cast(i as integer) as point, lo + i * step as x from shape cross join generate_series(0, 199) g(i)),
kernel as (
  select g.run_id, point, x, n, h, step, sum(exp(-0.5 * ((x - {value}) / h) * ((x - {value}) / h))) as k
  from grid g join {source} v on v.run_id = g.run_id group by all)"""
    select = f"""
select run_id, point, round(x, {x}) + 0.0 as x, round(k / (n * h * sqrt(2 * pi())), {density}) + 0.0 as density,
  round(k / (h * sqrt(2 * pi())) * step * 199 / 30, 6) + 0.0 as curve
from kernel"""
    return _sql(views, [*parts, grid], select)


def oracle_sql() -> dict[str, str]:
    more = llm.oracle_sql() if llm else {}
    pipeline = corpus_pipeline.ORACLE_SQL if corpus_pipeline else None
    return analytics_sql() | more | ({"pipeline": pipeline} if pipeline else {})


def analytics_sql() -> dict[str, str]:
    port, sym = "fx_portfolio", "fx_symbol"
    monthly = "select run_id, year(date) as year, month(date) as month, sum(daily_pnl_pct) as ret from fx_portfolio group by all"
    capital_rows = """
select run_id, date, strategy, round(capital - coalesce(lag(capital) over w, capital), 4) + 0.0 as daily_pnl,
  round((capital - coalesce(lag(capital) over w, capital)) / 10000, 8) + 0.0 as daily_pnl_pct,
  cast(0 as double) as commission, round(capital / 10000, 8) + 0.0 as net_value
from curves {where} window w as (partition by run_id, strategy order by date)"""
    return {
        "run_scorecard": _sql(port, [SCORECARD], "select * replace (round(comm_ratio, 4) + 0.0 as comm_ratio) from score"),
        "nav_drawdown": _sql(
            port, [NAV], f"select run_id, date, {_round(nav=8)}, round(nav - max(nav) over {BY_RUN}, 8) + 0.0 as drawdown from nav"
        ),
        # Net values that a run supplies are taken as they are.
        "nav_drawdown_supplied": _sql(
            "fx_capital",
            [],
            f"""select run_id, date, round(q5 / 10000, 8) + 0.0 as nav, round(q5 / 10000 - max(q5 / 10000) over {BY_RUN}, 8) + 0.0 as drawdown
from fx_capital""",
        ),
        "drawdown_relative": _sql(
            port, [NAV], f"select run_id, date, round(1 - nav / nullif(max(nav) over {BY_RUN}, 0), 8) + 0.0 as drawdown from nav"
        ),
        "daily_pnl": _sql(port, [], f"select run_id, date, {_round(daily_pnl=4)}, daily_pnl >= 0 as is_gain from fx_portfolio"),
        "active_return_hist": _hist_sql(port, [ACTIVE], "active", "return_pct", 8),
        "active_return_density": _density_sql(port, [ACTIVE], "active", "return_pct", 8, 6),
        "cost_curves": _sql(
            port,
            [],
            f"""select run_id, date, round(sum(daily_pnl + commission) over {BY_RUN}, 4) + 0.0 as cum_gross,
  round(sum(daily_pnl) over {BY_RUN}, 4) + 0.0 as cum_net, round(sum(commission) over {BY_RUN}, 4) + 0.0 as cum_commission
from fx_portfolio""",
        ),
        "activity": _sql(
            f"{port} {sym}",
            ["act as (select run_id, date, count(distinct spread) as n from fx_symbol where daily_pnl <> 0 group by 1, 2)"],
            """select p.run_id, p.date, num_trades, num_spreads, coalesce(n, 0) as active_spreads
from fx_portfolio p left join act using (run_id, date)""",
        ),
        "monthly_returns": _sql(
            port,
            [f"monthly as ({monthly})"],
            f"""select run_id, cast(year as integer) as year, cast(month as integer) as month,
  printf('%04d-%02d', year, month) as label, {_round(ret=8)}, ret >= 0 as is_gain from monthly""",
        ),
        "annual_returns": _sql(
            port,
            ["yearly as (select run_id, cast(year(date) as integer) as year, sum(daily_pnl_pct) as ret from fx_portfolio group by 1, 2)"],
            f"select run_id, year, {_round(ret=8)}, ret >= 0 as is_gain from yearly",
        ),
        "month_matrix": _sql(
            port,
            [f"monthly as ({monthly})"],
            "select run_id, cast(year as integer) as year, "
            + ", ".join(f"round(sum(ret) filter (month = {m}), 8) + 0.0 as m{m:02d}" for m in range(1, 13))
            + " from monthly where run_id in (select run_id from monthly group by 1 having count(*) >= 2) group by 1, 2",
        ),
        "rolling_metrics": _sql(
            port, [NAV, WINDOWS], f'select run_id, date, "window", {_round(sharpe=6, max_drawdown=8)} from measured'
        ),
        "rolling_sharpe": _sql(port, [NAV, WINDOWS], f'select run_id, date, {_round(sharpe=6)} from measured where "window" = 60'),
        "rolling_max_drawdown": _sql(
            port, [NAV, WINDOWS], f'select run_id, date, {_round(max_drawdown=8)} from measured where "window" = 60'
        ),
        "run_radar": _sql(
            port,
            [SCORECARD],
            """select run_id, axis, round(value, 6) + 0.0 as value from (
  select run_id, 'sharpe' as axis, greatest(0, least(sharpe / 2, 1)) as value from score
  union all select run_id, 'calmar', greatest(0, least(coalesce(calmar, 0) / 3, 1)) from score
  union all select run_id, 'win_rate', win_rate from score
  union all select run_id, 'total_return', greatest(0, least(total_return * 10, 1)) from score
  union all select run_id, 'net_of_commission', greatest(0, 1 - comm_ratio) from score)
where (select count(*) from score) >= 2""",
        ),
        "return_vs_drawdown": _sql(
            port,
            [SCORECARD],
            """select run_id, round(abs(max_drawdown) * 100, 6) + 0.0 as max_drawdown_pct,
  round(total_return * 100, 6) + 0.0 as total_return_pct from score where (select count(*) from score) >= 2""",
        ),
        "multi_nav": _sql(port, [NAV], f"select run_id, date, {_round(nav=8)} from nav"),
        "roundtrips": _sql(
            "fx_trades",
            [ROUNDTRIPS],
            f"""select run_id, instance_id, spread, direction, open_time, close_time, volume,
  {_round(open_price=4, close_price=4, commission=4, gross_pnl=4, holding_minutes=8)} from roundtrips""",
        ),
        "roundtrip_pnl_hist": _hist_sql("fx_trades", [ROUNDTRIPS], "roundtrips", "gross_pnl", 6),
        "roundtrip_pnl_density": _density_sql("fx_trades", [ROUNDTRIPS], "roundtrips", "gross_pnl", 6, 8),
        "holding_hours_hist": _hist_sql("fx_trades", [ROUNDTRIPS], "hours", "hours", 6),
        "holding_hours_density": _density_sql("fx_trades", [ROUNDTRIPS], "hours", "hours", 6, 8),
        "signal_fill_daily": _sql(
            "fx_signals fx_trades", [DAILY_CONVERSION], f"select run_id, date, signals, fills, {_round(conversion=8)} from daily"
        ),
        "signal_fill_monthly": _sql(
            "fx_signals fx_trades",
            [
                DAILY_CONVERSION,
                "span as (select run_id, date_trunc('month', min(date)) as a, date_trunc('month', max(date)) as b from daily group by 1)",
                "spine as (select run_id, last_day(cast(unnest(generate_series(a, b, interval 1 month)) as date)) as month_end from span)",
            ],
            """select s.run_id, s.month_end, round(avg(conversion), 8) + 0.0 as conversion
from spine s left join daily d on d.run_id = s.run_id and last_day(d.date) = s.month_end group by 1, 2""",
        ),
        "open_signal_oi": _sql(
            "fx_signals", [], f"select run_id, {_round(bar_oi=4, price=4)} from fx_signals where offset_ = 'open'"
        ),
        "signal_day_coverage": _sql(
            "fx_signals fx_trades",
            [
                "e as (select distinct run_id, cast(action_datetime as date) as date from fx_signals where offset_ = 'open')",
                "t as (select distinct run_id, cast(datetime as date) as date from fx_trades)",
            ],
            """select r.run_id, r.run_id in (select run_id from t) as has_fills,
  (select count(*) from (select date from e where e.run_id = r.run_id intersect select date from t where t.run_id = r.run_id)) as days_with_fill,
  (select count(*) from (select date from e where e.run_id = r.run_id except select date from t where t.run_id = r.run_id)) as days_signal_only
from (select distinct run_id from fx_signals) r""",
        ),
        "roll_events": _sql(
            f"{port} fx_rolls",
            [NAV],
            """select n.run_id, n.date, round(nav, 8) + 0.0 as nav,
  exists (select 1 from fx_rolls x where x.run_id = n.run_id and x.tradingday = n.date) as is_roll,
  (select count(distinct tradingday) from fx_rolls x where x.run_id = n.run_id) as roll_count
from nav n where n.run_id in (select run_id from fx_rolls)""",
        ),
        "roll_dates": _sql("fx_rolls", [], "select distinct run_id, tradingday as date from fx_rolls where tradingday is not null"),
        "spread_cumulative_pnl": _sql(sym, [TOTALS], f"select run_id, spread, {_round(pnl=4)} from totals"),
        "spread_nav": _sql(
            sym,
            [],
            """select run_id, spread, date, round(1 + sum(daily_pnl_pct) over (partition by run_id, spread order by date), 8) + 0.0 as nav
from fx_symbol""",
        ),
        "spread_nav_picks": _sql(
            f"{sym} {port}",
            [
                TOTALS,
                NAV,
                """ends as (
  select run_id, spread, row_number() over (partition by run_id order by pnl desc, spread) as place,
    count(*) over (partition by run_id) as spreads from totals)""",
            ],
            """select run_id, spread as series, date,
  round(1 + sum(daily_pnl_pct) over (partition by run_id, spread order by date), 8) + 0.0 as nav, false as is_portfolio
from fx_symbol join ends using (run_id, spread) where place <= 10 or place > spreads - 10
union all select run_id, 'portfolio', date, round(nav, 8) + 0.0, true from nav""",
        ),
        "spread_month_matrix": _sql(
            sym,
            [
                TOTALS,
                """big as (select * from (
  select run_id, spread, row_number() over (partition by run_id order by abs(pnl) desc, spread) as place
  from totals where pnl <> 0) where place <= 20)""",
                """m as (select run_id, spread, strftime(date, '%Y-%m') as ym, sum(daily_pnl_pct) as ret
  from fx_symbol join big using (run_id, spread) group by 1, 2, 3)""",
            ],
            """select b.run_id, b.spread, y.ym, round(coalesce(m.ret, 0), 8) + 0.0 as ret
from big b join (select distinct run_id, ym from m) y on y.run_id = b.run_id
left join m on m.run_id = b.run_id and m.spread = b.spread and m.ym = y.ym""",
        ),
        "spread_contribution": _sql(
            f"{sym} fx_trades",
            [
                TOTALS,
                "best as (select *, cast(row_number() over (partition by run_id order by pnl desc, spread) as integer) as rank from totals)",
                "n as (select run_id, spread, count(*) as trades from fx_trades group by 1, 2)",
            ],
            f"""select run_id, rank, spread, coalesce(trades, 0) as trades, pnl >= 0 as is_gain, {_round(pnl=4, commission=4)}
from best left join n using (run_id, spread) where rank <= 30""",
        ),
        "top_bottom_spreads": _sql(
            sym,
            [
                TOTALS,
                """ends as (
  select run_id, spread, pnl, row_number() over (partition by run_id order by pnl desc, spread) as place,
    count(*) over (partition by run_id) as spreads from totals)""",
            ],
            f"""select run_id, spread, {_round(pnl=4)}, cast(row_number() over (partition by run_id order by place) as integer) as pick
from ends where place <= 10 or place > spreads - 10""",
        ),
        "diagnostic_spreads": _sql(
            "fx_symbol_events",
            [DIAGNOSTIC],
            f"select d.run_id, d.spread, cast(pick as integer) as pick, {_round(pnl=4)} from diagnostic d join bar_totals using (run_id, spread)",
        ),
        "largest_spreads": _sql(
            sym,
            [TOTALS],
            f"""select * from (select run_id, spread, {_round(pnl=4)},
  cast(row_number() over (partition by run_id order by abs(totals.pnl) desc, spread) as integer) as rank
from totals where totals.pnl <> 0) where rank <= 20""",
        ),
        "active_spreads": _sql(
            sym,
            [TOTALS, PICKS_50],
            f"""select run_id, spread, {_round(active_pnl=4)}, cast(rank as integer) as rank from picks
where run_id in (select run_id from picks group by 1 having count(*) >= 2)""",
        ),
        "active_spreads_per_day": _sql(
            sym, [], "select run_id, date, count(distinct spread) as active_spreads from fx_symbol where daily_pnl <> 0 group by 1, 2"
        ),
        "active_spread_count": _sql(
            sym, [TOTALS, PICKS_50], "select run_id, date, count(*) filter (ret <> 0) as n from cells group by 1, 2"
        ),
        "spread_correlation": _sql(
            sym,
            [
                TOTALS,
                PICKS_50,
                """dense as (
  select p.run_id, p.spread, d.date, coalesce(c.ret, 0) as ret
  from picks p join (select distinct run_id, date from cells) d on d.run_id = p.run_id
  left join cells c on c.run_id = p.run_id and c.spread = p.spread and c.date = d.date)""",
            ],
            """select a.run_id, a.spread as s1, b.spread as s2,
  round(covar_pop(a.ret, b.ret) / nullif(stddev_pop(a.ret) * stddev_pop(b.ret), 0), 6) + 0.0 as corr
from dense a join dense b on a.run_id = b.run_id and a.date = b.date group by 1, 2, 3""",
        ),
        "sector_pnl": _sql(
            sym, [SECTOR_DAILY], "select run_id, sector, round(sum(pnl), 4) + 0.0 as pnl from sector_daily group by 1, 2"
        ),
        "sector_daily_pnl": _sql(sym, [SECTOR_DAILY], f"select run_id, date, sector, {_round(pnl=4)} from sector_daily"),
        "sector_box": _sql(
            sym,
            [
                SECTOR_DAILY,
                """q as (select run_id, sector, quantile_cont(pnl, 0.25) as q1, quantile_cont(pnl, 0.5) as med,
  quantile_cont(pnl, 0.75) as q3 from sector_daily group by 1, 2)""",
            ],
            """select run_id, sector, round(any_value(q1), 6) + 0.0 as q1, round(any_value(med), 6) + 0.0 as med, round(any_value(q3), 6) + 0.0 as q3,
  round(min(pnl) filter (pnl >= q1 - 1.5 * (q3 - q1)), 6) + 0.0 as whislo,
  round(max(pnl) filter (pnl <= q3 + 1.5 * (q3 - q1)), 6) + 0.0 as whishi
from sector_daily join q using (run_id, sector) group by 1, 2""",
        ),
        "zscore": _sql("fx_bars", [ZSCORE], f"select spread, datetime, close, row_id, {_round(z=6)} from scored"),
        "zscore_default": _sql(
            "fx_contract_bars",
            [ZSCORE.replace("= 20", "= 300").replace("19 preceding", "299 preceding").replace("fx_bars", "fx_contract_bars")],
            f"select spread, datetime, close, row_id, {_round(z=6)} from scored",
        ),
        "zscore_bars": _sql(
            "fx_bars fx_symbol_events",
            [DIAGNOSTIC, ZSCORE],
            f"""select d.run_id, spread, datetime, close, {_round(z=6)}, coalesce(abs(scored.z) >= 3.5, false) as beyond_entry,
  cast(3.5 as double) as entry_z, cast(0 as double) as exit_z
from diagnostic d join scored using (spread)""",
        ),
        "zscore_events": _sql(
            "fx_symbol_events fx_signals fx_trades fx_bars",
            [DIAGNOSTIC, "drawn as (select * from diagnostic where spread in (select spread from fx_bars))"],
            """select s.run_id, symbol as spread, 'entry' as kind, action_datetime as time, price
from fx_signals s join drawn d on d.run_id = s.run_id and d.spread = s.symbol where offset_ = 'open'
union all select t.run_id, t.spread, case offset_ when 'OPEN' then 'fill_open' else 'fill_close' end, datetime, price
from fx_trades t join drawn d on d.run_id = t.run_id and d.spread = t.spread""",
        ),
        "factor_ic": _sql("fx_ic", [], "select run_id, factor, ic_mean from fx_ic"),
        "synthesis_curves": _sql("fx_capital", [CURVES], f"select run_id, strategy, date, {_round(capital=2)} from curves"),
        "synthesis_fallback": _sql(
            "fx_capital fx_synthesis",
            [],
            f"select run_id, label, {_round(value=2)} from fx_synthesis where run_id not in (select run_id from fx_capital)",
        ),
        "quantile_spread": _sql("fx_capital", [], "select run_id, date, round(q5 - q1, 2) + 0.0 as spread from fx_capital"),
        "capital_to_portfolio": _sql("fx_capital", [CURVES], capital_rows.format(where="")),
        "first_strategy_portfolio": _sql("fx_capital", [CURVES], capital_rows.format(where=f"where strategy = '{STRATEGIES[0]}'")),
        "spread_names": _sql(
            f"{sym} fx_bars",
            [
                """names as (select spread from fx_symbol union select spread from fx_bars
  union select cast(p_partkey as varchar) from part union select p_brand from part)""",
                """legs as (select spread, split_part(spread, '&', 1) as leg1, split_part(spread, '&', 2) as leg2,
  regexp_replace(split_part(spread, '&', 1), '[^A-Za-z]', '', 'g') as letters1,
  regexp_replace(split_part(spread, '&', 2), '[^A-Za-z]', '', 'g') as letters2 from names)""",
            ],
            """select spread, case when letters1 <> '' then upper(letters1) else substr(leg1, 1, 2) end as prefix,
  lower(case when letters1 <> '' then letters1 else substr(leg1, 1, 1) end) as product,
  case when contains(spread, '&') then upper(letters1) || '&' || upper(letters2) else spread end as folder
from legs""",
        ),
        "localised_portfolio": _sql(
            port,
            [],
            f"""select run_id, date, {_round(daily_pnl=4, daily_pnl_pct=8)}, num_trades,
  cast(case when date < date '1998-01-01' then num_spreads end as integer) as num_spreads from fx_portfolio""",
        ),
        "lenient_numbers": """
select event_id, case event_id % 5 when 0 then null when 2 then null when 3 then round(round(value, 2) * 10, 4)
  else round(value, 2) end as number
from events""",
    }
