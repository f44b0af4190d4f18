"""Comparison across runs: net values, normalised radar axes, return against drawdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.functions.columns import clip01
from stratlens.operators.returns import portfolio_nav, summarize_returns


def run_scorecard(portfolio: DataFrame, block: str | None = None) -> DataFrame:
    """The performance summary and commission ratio of every run."""
    return summarize_returns(portfolio, ("run_id",), block)


def multi_nav(portfolio: DataFrame, block: str | None = None) -> DataFrame:
    """Net values of all runs, if there are at least two to compare."""
    priced = portfolio_nav(portfolio, ("run_id",), block).select("run_id", "date", "nav")
    return priced.filter(_several(portfolio))


def _several(runs: DataFrame) -> Column:
    """Whether the table holds at least two runs: one row per run and task is counted."""
    return runs.agg((F.count_distinct("run_id") >= 2).alias("many")).scalar()


def _comparable(scorecard: DataFrame) -> DataFrame:
    """Keep nothing unless there are at least two runs to compare."""
    return scorecard.filter(_several(scorecard))


def run_radar(scorecard: DataFrame) -> DataFrame:
    """Five axes per run, scaled so that a strong run reaches one."""
    def axis(name: str, value):
        return F.struct(F.lit(name).alias("axis"), value.cast("double").alias("value"))

    axes = F.array(
        axis("sharpe", clip01(F.col("sharpe") / 2.0)),
        axis("calmar", clip01(F.coalesce("calmar", F.lit(0.0)) / 3.0)),
        axis("win_rate", F.col("win_rate")),
        axis("total_return", clip01(F.col("total_return") * 10.0)),
        axis("net_of_commission", F.greatest(F.lit(1.0) - F.col("comm_ratio"), F.lit(0.0))),
    )
    return _comparable(scorecard).select("run_id", F.inline(axes))


def return_vs_drawdown(scorecard: DataFrame) -> DataFrame:
    """Each run's depth of drawdown and total return, both in percent."""
    return _comparable(scorecard).select(
        "run_id",
        (F.abs(F.coalesce("max_drawdown", F.lit(0.0))) * 100).alias("max_drawdown_pct"),
        (F.col("total_return") * 100).alias("total_return_pct"),
    )
