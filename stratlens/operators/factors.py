"""Factor information coefficients and capital-curve comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratlens.functions.columns import named_or_at


def factor_ic(ic: DataFrame) -> DataFrame:
    """Mean information coefficient per factor; tables without these names use their end columns."""
    columns = [name for name in ic.columns if name != "run_id"]
    factor, value = named_or_at(columns, "factor", 0), named_or_at(columns, "ic_mean", -1)
    return ic.select(
        "run_id", F.coalesce(F.col(factor).cast("string"), F.lit("nan")).alias("factor"), F.col(value).cast("double").alias("ic_mean")
    )


def unpivot_curves(wide: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Wide ``run_id, date, <strategy…>`` to one row per date and strategy, keeping column order."""
    numbers = wide.select("run_id", "date", *[F.col(f"`{s}`").cast("double").alias(s) for s in strategies])
    long = numbers.unpivot(["run_id", "date"], list(strategies), "strategy", "capital")
    places = F.create_map(*[part for i, s in enumerate(strategies) for part in (F.lit(s), F.lit(i))])
    return long.select("run_id", "date", "strategy", places[F.col("strategy")].alias("col_pos"), "capital")


def capital_curves(curves: DataFrame) -> DataFrame:
    return curves.select("run_id", "strategy", "date", "capital")


def synthesis_fallback(curves: DataFrame, synthesis: DataFrame) -> DataFrame:
    """Summary bars for the runs that have no capital curves."""
    return synthesis.join(curves.select("run_id").distinct(), "run_id", "left_anti").select("run_id", "label", "value")


def quantile_spread(curves: DataFrame) -> DataFrame:
    """First minus last curve per date; runs with a single curve have none."""
    ends = curves.groupBy("run_id", "date").agg(
        F.min_by("capital", "col_pos").alias("top"),
        F.max_by("capital", "col_pos").alias("bottom"),
        F.min("col_pos").alias("first"),
        F.max("col_pos").alias("last"),
    )
    return ends.filter("first < last").select("run_id", "date", (F.col("top") - F.col("bottom")).alias("spread"))
