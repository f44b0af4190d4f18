"""The dataset behind every report, for all runs at once."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.functions.columns import beyond_entry, is_gain, return_or_zero
from stratlens.operators import compare, factors, returns, rolling, signals, trades, universe
from stratlens.operators.joins import salted_join
from stratlens.operators.ordered import BLOCK, range_blocks
from stratlens.operators.returns import daily_order
from stratlens.sources.tables import RunTables


@dataclass(frozen=True)
class Options:
    """Report parameters and their usual values."""

    top_n: int = 10
    rolling_windows: tuple[int, ...] = (60, 120)
    lookback: int = 300
    entry_z: float = 3.5
    exit_z: float = 0.0
    diagnostic_n: int = 5
    bins: int = 30
    # Calendar units at which series are cut first; a unit with many rows of a key is cut further.
    fill_unit: str = "month"
    bar_unit: str = "month"
    daily_unit: str = "year"


Datasets = dict[str, DataFrame]


# --- portfolio ---------------------------------------------------------------
def nav_drawdown(portfolio: DataFrame, block: str | None = None) -> DataFrame:
    priced = returns.portfolio_nav(portfolio, block=block)
    return returns.drawdown_additive(priced, block=block).select("run_id", "date", "nav", "drawdown")


def daily_pnl(portfolio: DataFrame) -> DataFrame:
    return portfolio.select("run_id", "date", "daily_pnl", is_gain("daily_pnl").alias("is_gain"))


def active_returns_pct(portfolio: DataFrame) -> DataFrame:
    """Returns other than zero, in percent."""
    active = portfolio.filter(return_or_zero() != 0)
    return active.select("run_id", "date", (return_or_zero() * 100).alias("return_pct"))


def cost_curves(portfolio: DataFrame, block: str | None = None) -> DataFrame:
    curves = returns.cost_curves(portfolio, block=block)
    return curves.select("run_id", "date", "cum_gross", "cum_net", "cum_commission")


def rolling_metrics(portfolio: DataFrame, windows: Sequence[int], block: str | None = None) -> DataFrame:
    return rolling.rolling_metrics(returns.portfolio_nav(portfolio, block=block), windows, block=block)


# --- trades ------------------------------------------------------------------
def roundtrips(fills: DataFrame, unit: str = Options.fill_unit) -> DataFrame:
    """Matched trades, over series cut at the calendar ``unit`` and inside it."""
    return trades.pair_roundtrips(range_blocks(fills, trades.SERIES, trades.FILL_ORDER, unit), BLOCK)


def holding_hours(matched: DataFrame) -> DataFrame:
    """Holding time of every trade in hours."""
    return matched.withColumn("hours", F.col("holding_minutes") / 60)


# --- diagnostics -------------------------------------------------------------
def diagnostic_bars(symbol: DataFrame, bars: DataFrame, options: Options, totals: DataFrame | None = None) -> DataFrame:
    """Close and z-score of each run's diagnostic spreads, with the threshold bands."""
    totals = universe.spread_totals(symbol) if totals is None else totals
    picks = universe.diagnostic_spreads(totals, options.diagnostic_n).select("run_id", "spread")
    wanted = range_blocks(bars.join(picks, "spread", "left_semi"), ["spread"], ["datetime", "row_id"], options.bar_unit)
    scored = rolling.zscore(wanted, options.lookback, block=BLOCK)
    return salted_join(scored, picks, ["spread"]).select(
        "run_id",
        "spread",
        "datetime",
        "close",
        "z",
        F.coalesce(beyond_entry("z", options.entry_z), F.lit(False)).alias("beyond_entry"),
        F.lit(float(options.entry_z)).alias("entry_z"),
        F.lit(float(options.exit_z)).alias("exit_z"),
    )


def diagnostic_events(
    symbol: DataFrame, signal_rows: DataFrame, fills: DataFrame, bars: DataFrame, options: Options, totals: DataFrame | None = None
) -> DataFrame:
    """Events of the diagnostic spreads that have bars."""
    totals = universe.spread_totals(symbol) if totals is None else totals
    picks = universe.diagnostic_spreads(totals, options.diagnostic_n)
    picks = picks.join(bars.select("spread"), "spread", "left_semi")
    return signals.chart_events(picks, signal_rows, fills)


# --- report list -------------------------------------------------------------
def _r01(t: RunTables, o: Options) -> Datasets:
    return {"nav_drawdown": nav_drawdown(t.portfolio, t.portfolio_block)}


def _r02(t: RunTables, o: Options) -> Datasets:
    active = active_returns_pct(t.portfolio)
    return {
        "daily_pnl": daily_pnl(t.portfolio),
        "active_return_hist": trades.histogram(active, "return_pct", o.bins),
        "active_return_density": trades.density(active, "return_pct", bins=o.bins),
    }


def _r03(t: RunTables, o: Options) -> Datasets:
    return {
        "spread_nav_picks": universe.spread_nav_picks(t.symbol, t.portfolio, o.top_n, t.symbol_block, t.portfolio_block, t.totals),
        "spread_month_matrix": universe.spread_month_matrix(t.symbol, totals=t.totals),
    }


def _r04(t: RunTables, o: Options) -> Datasets:
    return {"cost_curves": cost_curves(t.portfolio, t.portfolio_block)}


def _r05(t: RunTables, o: Options) -> Datasets:
    return {"activity": universe.activity(t.portfolio, t.symbol)}


def _r06(t: RunTables, o: Options) -> Datasets:
    matched = roundtrips(t.trades, o.fill_unit) if t.matched is None else t.matched
    hours = holding_hours(matched)
    return {
        "roundtrips": matched,
        "roundtrip_pnl_hist": trades.histogram(matched, "gross_pnl", o.bins),
        "roundtrip_pnl_density": trades.density(matched, "gross_pnl", bins=o.bins),
        "holding_hours_hist": trades.histogram(hours, "hours", o.bins, above=0.0),
        "holding_hours_density": trades.density(hours, "hours", bins=o.bins, above=0.0),
    }


def _r07(t: RunTables, o: Options) -> Datasets:
    return {"spread_contribution": universe.spread_contribution(t.symbol, t.trades, totals=t.totals)}


def _r09(t: RunTables, o: Options) -> Datasets:
    daily = signals.signal_fill_daily(t.signals, t.trades)
    return {"signal_fill_daily": daily, "signal_fill_monthly": signals.signal_fill_monthly(daily)}


def _r10(t: RunTables, o: Options) -> Datasets:
    return {
        "open_signal_oi": signals.open_signal_oi(t.signals),
        "signal_day_coverage": signals.signal_day_coverage(t.signals, t.trades),
    }


def _r11(t: RunTables, o: Options) -> Datasets:
    return {
        "roll_events": signals.roll_events(t.portfolio, t.rolls, t.portfolio_block),
        "roll_dates": signals.roll_dates(t.rolls),
    }


def _r12(t: RunTables, o: Options) -> Datasets:
    return {
        "monthly_returns": returns.monthly_returns(t.portfolio),
        "annual_returns": returns.annual_returns(t.portfolio),
        "month_matrix": returns.month_matrix(t.portfolio),
    }


def _r13(t: RunTables, o: Options) -> Datasets:
    return {"rolling_metrics": rolling_metrics(t.portfolio, o.rolling_windows, t.portfolio_block)}


def _r14(t: RunTables, o: Options) -> Datasets:
    scorecard = compare.run_scorecard(t.portfolio, t.portfolio_block)
    return {
        "run_scorecard": scorecard,
        "multi_nav": compare.multi_nav(t.portfolio, t.portfolio_block),
        "run_radar": compare.run_radar(scorecard),
        "return_vs_drawdown": compare.return_vs_drawdown(scorecard),
    }


def _r15(t: RunTables, o: Options) -> Datasets:
    return {
        "spread_correlation": universe.spread_correlation(t.symbol, totals=t.totals, cells=t.cells),
        "active_spread_count": universe.active_spread_count(t.symbol, totals=t.totals, cells=t.cells),
        "sector_pnl": universe.sector_pnl(t.symbol),
        "sector_box": universe.sector_box(t.symbol),
    }


def _r16(t: RunTables, o: Options) -> Datasets:
    return {"factor_ic": factors.factor_ic(t.ic_summary)}


def _r17(t: RunTables, o: Options) -> Datasets:
    return {
        "synthesis_curves": factors.capital_curves(t.capital_curves),
        "synthesis_fallback": factors.synthesis_fallback(t.capital_curves, t.synthesis_summary),
    }


def _r19(t: RunTables, o: Options) -> Datasets:
    return {"quantile_spread": factors.quantile_spread(t.capital_curves)}


REPORTS: dict[str, Callable[[RunTables, Options], Datasets]] = {
    "01": _r01, "02": _r02, "03": _r03, "04": _r04, "05": _r05, "06": _r06, "07": _r07, "09": _r09,
    "10": _r10, "11": _r11, "12": _r12, "13": _r13, "14": _r14, "15": _r15, "16": _r16, "17": _r17,
    "18": _r16, "19": _r19,
}

# --- fixed values: which reports a named group holds, per kind of run ---------
SPREAD_GROUPS = {
    "common": ("01", "02", "12", "13"),
    "universe": ("01", "02", "03", "04", "05", "06", "07", "12", "13", "15"),
    "diagnostic": ("08", "09", "10", "11"),
    "all": ("01", "02", "03", "04", "05", "06", "07", "08", "09", "10", "11", "12", "13", "14", "15"),
}
EQUITY_GROUPS = {
    "common": ("01", "02", "12", "13"),
    "equity": ("01", "02", "12", "13", "16", "17", "18", "19"),
    "all": ("01", "02", "12", "13", "16", "17", "18", "19"),
}
# ------------------------------------------------------------------------------


def cut_daily(tables: RunTables, unit: str = Options.daily_unit) -> RunTables:
    """The tables with their daily series cut at the calendar ``unit`` and inside it.

    A file may hold many rows per date (one per strategy, say), so the calendar alone is no bound.
    """
    return replace(
        tables,
        portfolio=range_blocks(tables.portfolio, ["run_id"], daily_order(tables.portfolio), unit),
        symbol=range_blocks(tables.symbol, ["run_id", "spread"], daily_order(tables.symbol), unit),
        portfolio_block=BLOCK,
        symbol_block=BLOCK,
    )


# Which reports need a table that is worth making once.
SHARED = {
    "totals": ("03", "07", "08", "15"),
    "cells": ("15",),
    "matched": ("06",),
    "portfolio": ("01", "03", "11", "13", "14"),
}


def share(tables: RunTables, wanted: Collection[str], root: str, options: Options) -> RunTables:
    """The tables with what several of the ``wanted`` reports derive from them, each made once and written below ``root``.

    Totals per spread, the picked spreads' cells (made from the written totals), the matched trades, and the
    portfolio with its net value and pieces. Reports then read these narrow tables; without ``share`` each report has its own branch
    for them. What an earlier build left under ``root`` is replaced.
    """

    def made(name: str, build: Callable[[RunTables], DataFrame]) -> None:
        nonlocal tables
        if set(SHARED[name]) & set(wanted):
            df = build(tables)
            df.write.mode("overwrite").parquet(f"{root}/{name}")
            tables = replace(tables, **{name: df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}")})

    made("totals", lambda t: universe.spread_totals(t.symbol))
    made("cells", lambda t: universe.pick_cells(t.symbol, totals=t.totals))
    made("matched", lambda t: roundtrips(t.trades, options.fill_unit))
    made("portfolio", lambda t: returns.portfolio_nav(t.portfolio, block=t.portfolio_block))
    return tables


def groups_for(adapter: str) -> dict[str, tuple[str, ...]]:
    return EQUITY_GROUPS if adapter == "equity" else SPREAD_GROUPS


def build_reports(
    tables: RunTables,
    group: str = "all",
    adapter: str = "spread",
    options: Options | None = None,
    bars: DataFrame | None = None,
    compare_runs: bool = False,
    shared_root: str | None = None,
) -> Datasets:
    """Every dataset of a report group.

    Report 08 needs ``bars`` and is skipped without them; report 14 compares runs and is built
    only when asked for, whatever the group. Every report scans the tables anew, so tables read
    from CSV are best staged first (``sources.sink.stage_tables``). With ``shared_root``, a folder, what several
    reports have in common is written there first (``share``), which runs jobs; without it
    nothing runs before a dataset is read.
    """
    options = options or Options()
    groups = groups_for(adapter)
    if group not in groups:
        raise ValueError(f"report group must be one of {sorted(groups)}")
    tables = cut_daily(tables, options.daily_unit)
    wanted = [r for r in groups[group] if r != "14"] + (["14"] if compare_runs else [])
    if shared_root:
        tables = share(tables, [r for r in wanted if r != "08" or bars is not None], shared_root, options)
    built: Datasets = {}
    for report in wanted:
        if report == "08":
            if bars is not None:
                built["zscore_bars"] = diagnostic_bars(tables.symbol, bars, options, tables.totals)
                built["zscore_events"] = diagnostic_events(
                    tables.symbol, tables.signals, tables.trades, bars, options, tables.totals
                )
        else:
            built.update(REPORTS[report](tables, options))
    return built
