"""Signals against fills, and roll events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.functions.columns import safe_ratio, side
from stratlens.operators.joins import salted_join
from stratlens.operators.returns import portfolio_nav


def _per_day(df: DataFrame, time: str, name: str) -> DataFrame:
    dated = df.filter(F.col(time).isNotNull())
    return dated.groupBy("run_id", F.to_date(time).alias("date")).agg(F.count(F.lit(1)).alias(name))


def signals_per_day(signals: DataFrame) -> DataFrame:
    return _per_day(signals, "action_datetime", "signals")


def fills_per_day(fills: DataFrame) -> DataFrame:
    return _per_day(fills, "datetime", "fills")


def signal_fill_daily(signals: DataFrame, fills: DataFrame) -> DataFrame:
    """Signals, fills and fills per signal on every day that has either; no signal counts as 0."""
    both = signals_per_day(signals).join(fills_per_day(fills), ["run_id", "date"], "full_outer")
    counted = both.select(
        "run_id",
        "date",
        F.coalesce("signals", F.lit(0)).alias("signals"),
        F.coalesce("fills", F.lit(0)).alias("fills"),
    )
    return counted.withColumn("conversion", F.coalesce(safe_ratio("fills", "signals"), F.lit(0.0)))


def signal_fill_monthly(daily: DataFrame) -> DataFrame:
    """Mean conversion per month end, without gaps; a month without days has no value."""
    means = daily.groupBy("run_id", F.last_day("date").alias("month_end")).agg(F.avg("conversion").alias("conversion"))
    # One entry per calendar month, so a run's list stays short.
    runs = means.groupBy("run_id").agg(
        F.min("month_end").alias("_from"),
        F.max("month_end").alias("_to"),
        F.map_from_entries(F.collect_list(F.struct("month_end", "conversion"))).alias("_means"),
    )
    first_days = F.sequence(F.trunc("_from", "month"), F.trunc("_to", "month"), F.expr("interval 1 month"))
    months = runs.select("run_id", "_means", F.explode(first_days).alias("_first"))
    month_end = F.last_day("_first")
    return months.select("run_id", month_end.alias("month_end"), F.try_element_at("_means", month_end).alias("conversion"))


def open_signals(signals: DataFrame) -> DataFrame:
    """Entry signals; the word is matched exactly, unlike on fills."""
    return signals.filter(F.col("offset") == "open")


def open_signal_oi(signals: DataFrame) -> DataFrame:
    """Open interest and price of every entry signal."""
    return open_signals(signals).select("run_id", F.col("bar_oi").cast("double").alias("bar_oi"), "price")


def signal_day_coverage(signals: DataFrame, fills: DataFrame) -> DataFrame:
    """Entry-signal days with and without a fill; without any fills all of them are signal-only."""

    def marks(df: DataFrame, time: str, signal, entry, fill) -> DataFrame:
        day = F.to_date(time)
        return df.select(
            "run_id", day.alias("date"), signal.alias("signal"), (entry & day.isNotNull()).alias("entry"), fill.alias("fill")
        )

    yes, no = F.lit(True), F.lit(False)
    opening = F.coalesce(F.col("offset") == "open", no)
    both = marks(signals, "action_datetime", yes, opening, no).unionByName(marks(fills, "datetime", no, no, yes))
    days = both.groupBy("run_id", "date").agg(*[F.bool_or(c).alias(c) for c in ("signal", "entry", "fill")])
    runs = days.groupBy("run_id").agg(
        F.bool_or("signal").alias("signal"),
        F.bool_or("fill").alias("has_fills"),
        F.count_if(F.col("entry") & F.col("fill")).alias("days_with_fill"),
        F.count_if(F.col("entry") & ~F.col("fill")).alias("days_signal_only"),
    )
    return runs.filter("signal").drop("signal")


def roll_dates(rolls: DataFrame) -> DataFrame:
    """Each run's distinct roll dates."""
    return rolls.select("run_id", F.col("tradingday").alias("date")).filter(F.col("date").isNotNull()).distinct()


def roll_events(portfolio: DataFrame, rolls: DataFrame, block: str | None = None) -> DataFrame:
    """Portfolio net value with roll dates marked, for runs that have a roll table."""
    counts = rolls.groupBy("run_id").agg(F.count_distinct("tradingday").alias("roll_count"))
    nav = salted_join(portfolio_nav(portfolio, block=block), counts, ["run_id"])
    marked = nav.join(roll_dates(rolls).withColumn("is_roll", F.lit(True)), ["run_id", "date"], "left")
    return marked.select("run_id", "date", "nav", F.coalesce("is_roll", F.lit(False)).alias("is_roll"), "roll_count")


def chart_events(picks: DataFrame, signals: DataFrame, fills: DataFrame) -> DataFrame:
    """Entry signals, opening and closing fills of the picked spreads as one typed event list."""

    def events(rows: DataFrame, spread: str, time: str, kind: Column) -> DataFrame:
        return rows.select("run_id", F.col(spread).alias("spread"), kind.alias("kind"), F.col(time).alias("time"), "price")

    offset = side("offset")
    entries = events(open_signals(signals), "symbol", "action_datetime", F.lit("entry"))
    kinds = F.when(offset == "OPEN", "fill_open").when(offset == "CLOSE", "fill_close")
    traded = events(fills, "spread", "datetime", kinds).filter(F.col("kind").isNotNull())
    return entries.unionByName(traded).join(picks.select("run_id", "spread"), ["run_id", "spread"], "left_semi")
