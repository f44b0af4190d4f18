"""Net value, drawdown, cost curves, calendar returns and the per-run performance summary.

Returns add up (they are never compounded). Inputs are daily tables: one row per key and date,
so a series is bounded by the calendar; pass ``block`` (see ``ordered.range_blocks``) otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import is_gain, month_label, return_or_zero, safe_ratio
from stratlens.operators.joins import salted_join
from stratlens.operators.ordered import BLOCK, cumulative, previous, range_blocks
from stratlens.schemas import TRADING_DAYS

RUN = ("run_id",)


def daily_order(df: DataFrame) -> list[str]:
    """Sort columns of a daily table: date, then strategy and row number where present."""
    return ["date"] + [name for name in ("strategy", "row_id") if name in df.columns]


def net_value(df: DataFrame, keys: Sequence[str] = RUN, name: str = "nav", block: str | None = None) -> DataFrame:
    """``1 + running sum of returns``; a missing return counts as zero."""
    summed = cumulative(df, keys, daily_order(df), {name: ("sum", return_or_zero())}, block)
    return summed.withColumn(name, F.lit(1.0) + F.col(name))


def portfolio_nav(df: DataFrame, keys: Sequence[str] = RUN, block: str | None = None) -> DataFrame:
    """Add ``nav``: the supplied ``net_value`` of a run where it has one, else the summed one.

    A table that has ``nav`` already (see ``reports.share``) stays as it is.
    """
    if "nav" in df.columns:
        return df
    if "net_value" not in df.columns:
        return net_value(df, keys, "nav", block)
    supplied = F.max(F.col("net_value").isNotNull())
    if block:
        flags = df.groupBy(*keys).agg(supplied.alias("_supplied"))
        flagged = salted_join(df, flags, keys)
    else:
        flagged = df.withColumn("_supplied", supplied.over(Window.partitionBy(*keys)))
    summed = net_value(flagged, keys, "nav", block)
    return summed.withColumn("nav", F.when(F.col("_supplied"), F.col("net_value")).otherwise(F.col("nav"))).drop("_supplied")


def drawdown_additive(
    df: DataFrame, keys: Sequence[str] = RUN, nav: str = "nav", name: str = "drawdown", block: str | None = None
) -> DataFrame:
    """``nav`` minus its running maximum."""
    peaked = cumulative(df, keys, daily_order(df), {"_peak": ("max", F.col(nav))}, block)
    return peaked.withColumn(name, F.col(nav) - F.col("_peak")).drop("_peak")


def drawdown_relative(
    df: DataFrame, keys: Sequence[str] = RUN, nav: str = "nav", name: str = "drawdown", block: str | None = None
) -> DataFrame:
    """``1 - nav / running maximum``; missing while the maximum is zero."""
    peaked = cumulative(df, keys, daily_order(df), {"_peak": ("max", F.col(nav))}, block)
    return peaked.withColumn(name, F.lit(1.0) - safe_ratio(nav, "_peak")).drop("_peak")


def cost_curves(df: DataFrame, keys: Sequence[str] = RUN, block: str | None = None) -> DataFrame:
    """Running gross (before commission), net and commission totals."""
    outputs = {
        "cum_gross": ("sum", F.col("daily_pnl") + F.col("commission")),
        "cum_net": ("sum", F.col("daily_pnl")),
        "cum_commission": ("sum", F.col("commission")),
    }
    return cumulative(df, keys, daily_order(df), outputs, block)


def summarize_returns(df: DataFrame, keys: Sequence[str] = RUN, block: str | None = None) -> DataFrame:
    """One performance row per run, with the commission ratio where money columns are present."""
    series = df.withColumn("_r", return_or_zero())
    summed = cumulative(series, keys, daily_order(df), {"_cum": ("sum", F.col("_r"))}, block)
    dipped = drawdown_additive(summed, keys, "_cum", "_dd", block)

    days = F.count(F.lit(1))
    active = F.count_if(F.col("_r") != 0)
    total = F.sum("_r")
    annual = total / days * F.lit(float(TRADING_DAYS))
    spread = F.coalesce(F.stddev_samp("_r"), F.lit(0.0))
    sharpe = F.coalesce(safe_ratio(F.avg("_r"), spread), F.lit(0.0)) * F.lit(math.sqrt(TRADING_DAYS))
    worst = F.min("_dd")
    columns = [
        days.alias("days"),
        active.alias("active_days"),
        F.bround(total, 6).alias("total_return"),
        F.bround(annual, 6).alias("annual_return"),
        F.bround(sharpe, 4).alias("sharpe"),
        F.bround(worst, 6).alias("max_drawdown"),
        F.bround(safe_ratio(annual, F.abs(worst)), 4).alias("calmar"),
        F.bround(F.coalesce(safe_ratio(F.count_if(F.col("_r") > 0), active), F.lit(0.0)), 4).alias("win_rate"),
    ]
    if {"daily_pnl", "commission"} <= set(df.columns):
        fees = F.coalesce(F.sum("commission"), F.lit(0.0))
        gross = F.coalesce(F.sum("daily_pnl"), F.lit(0.0)) + fees
        columns.append((fees / F.greatest(F.abs(gross), F.lit(1.0))).alias("comm_ratio"))
    return dipped.groupBy(*keys).agg(*columns)


def monthly_returns(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Summed return per calendar month."""
    return (
        df.filter(F.col("date").isNotNull())
        .groupBy(*keys, F.year("date").alias("year"), F.month("date").alias("month"))
        .agg(F.sum(return_or_zero()).alias("ret"))
        .withColumn("label", month_label(F.make_date("year", "month", F.lit(1))))
        .withColumn("is_gain", is_gain("ret"))
    )


def annual_returns(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Summed return per calendar year."""
    dated = df.filter(F.col("date").isNotNull())
    yearly = dated.groupBy(*keys, F.year("date").alias("year")).agg(F.sum(return_or_zero()).alias("ret"))
    return yearly.withColumn("is_gain", is_gain("ret"))


def month_matrix(df: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Year by month returns in columns ``m01`` to ``m12``; runs with a single month have none."""
    monthly = monthly_returns(df, keys)
    months = F.sum(F.size(F.array_compact(F.array(*[f"m{m:02d}" for m in range(1, 13)]))))
    wide = monthly.groupBy(*keys, "year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    named = wide.select(*keys, "year", *[F.col(str(m)).alias(f"m{m:02d}") for m in range(1, 13)])
    counted = named.withColumn("_months", months.over(Window.partitionBy(*keys)))
    return counted.filter("_months >= 2").drop("_months")


def capital_to_portfolio(
    curves: DataFrame, initial_capital: float = 10000.0, strategy: str = "", unit: str = "year"
) -> DataFrame:
    """Daily portfolio rows from long capital curves, cut at the calendar ``unit`` for the changes.

    With no ``strategy`` named every curve is converted; ``first_strategy`` picks one per run.
    """
    chosen = curves.filter(F.col("strategy") == strategy) if strategy else curves
    nav = F.col("capital") / F.lit(float(initial_capital)) if initial_capital else F.col("capital")

    def change(column: str):
        return F.coalesce(F.col(column) - F.col(f"_before.{column}"), F.lit(0.0))

    keys = ["run_id", "strategy"]
    cut = range_blocks(chosen.withColumn("net_value", nav), keys, ["date"], unit)
    both = F.struct("capital", "net_value")
    return (
        previous(cut, keys, ["date"], both, "_before", BLOCK)
        .withColumn("daily_pnl", change("capital"))
        .withColumn("daily_pnl_pct", change("net_value"))
        .withColumn("commission", F.lit(0.0))
        .select("run_id", "date", "strategy", "daily_pnl", "daily_pnl_pct", "commission", "net_value")
    )


def first_strategy(curves: DataFrame) -> DataFrame:
    """Only each run's first curve (lowest column position)."""
    heads = curves.groupBy("run_id").agg(F.min("col_pos").alias("col_pos"))
    return curves.join(heads, ["run_id", "col_pos"], "left_semi").select(*curves.columns)
