"""Sliding-window Sharpe, z-score and maximum drawdown.

A window counts ``window`` rows and gives a value only when all of them are present. Moments come
from differences of running sums inside segments, so the cost per row does not grow with the
window; sums are taken around the segment's first value, which keeps the differences accurate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import finite, return_or_zero, safe_ratio
from stratlens.operators.ordered import segments
from stratlens.operators.returns import RUN, daily_order
from stratlens.schemas import TRADING_DAYS


def rolling_moments(
    segmented: DataFrame, keys: Sequence[str], value: Column, windows: Sequence[int]
) -> DataFrame:
    """Add ``mean_<w>`` and ``std_<w>`` (sample deviation, missing where it would be zero)."""
    by_pos = Window.partitionBy(*keys, "segment").orderBy("pos")
    upto = by_pos.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centred = segmented.withColumn("_x", finite(value)).withColumn("_c", F.first("_x", ignorenulls=True).over(upto))
    # The centre must be one number per segment; rows before the first value carry no sums anyway.
    shift = F.coalesce(F.col("_x") - F.col("_c"), F.lit(0.0))
    summed = centred.withColumn("_d", shift).withColumns(
        {
            "_n": F.count("_x").over(upto),
            "_s1": F.sum("_d").over(upto),
            "_s2": F.sum(F.col("_d") * F.col("_d")).over(upto),
            "_moved": ~F.col("_x").eqNullSafe(F.lag("_x").over(by_pos)) | (F.row_number().over(by_pos) == 1),
        }
    ).withColumn("_since", F.max(F.when(F.col("_moved"), F.col("pos"))).over(upto))
    earlier = summed.withColumns(
        {
            f"{name}_{w}": F.col(name) - F.coalesce(F.lag(name, w).over(by_pos), F.lit(0))
            for w in windows
            for name in ("_n", "_s1", "_s2")
        }
    )
    results = {}
    for w in windows:
        full = F.col(f"_n_{w}") == w
        flat = F.col("pos") - F.col("_since") >= w - 1
        mean = F.col("_c") + F.col(f"_s1_{w}") / w
        around = F.col(f"_s2_{w}") - F.col(f"_s1_{w}") * F.col(f"_s1_{w}") / w
        results[f"mean_{w}"] = F.when(full, mean)
        if w > 1:
            results[f"std_{w}"] = F.when(full & ~flat & (around > 0), F.sqrt(around / (w - 1)))
        else:
            results[f"std_{w}"] = F.lit(None).cast("double")
    scratch = ["_x", "_c", "_d", "_n", "_s1", "_s2", "_moved", "_since"]
    scratch += [f"{name}_{w}" for w in windows for name in ("_n", "_s1", "_s2")]
    return earlier.withColumns(results).drop(*scratch)


def _sharpe(window: int) -> Column:
    return F.col(f"mean_{window}") / F.col(f"std_{window}") * F.lit(math.sqrt(TRADING_DAYS))


def rolling_sharpe(df: DataFrame, window: int, keys: Sequence[str] = RUN, block: str | None = None) -> DataFrame:
    """Add ``sharpe`` over the last ``window`` returns."""
    cut = segments(df, keys, daily_order(df), window, block)
    moved = rolling_moments(cut, keys, return_or_zero(), [window])
    kept = moved.filter(~F.col("is_lead")).withColumn("sharpe", _sharpe(window))
    return kept.select(*df.columns, "sharpe")


def _dips(left: Column, right: Column) -> Column:
    """Largest and smallest value and deepest dip of two stretches in a row, from those of either."""
    across = right["lo"] - left["hi"]
    return F.struct(
        F.greatest(left["hi"], right["hi"]).alias("hi"),
        F.least(left["lo"], right["lo"]).alias("lo"),
        F.least(left["dip"], right["dip"], across).alias("dip"),
    )


def _add_drawdowns(segmented: DataFrame, keys: Sequence[str], nav: str, windows: Sequence[int]) -> DataFrame:
    """Add ``mdd_<w>``: the deepest dip below the peak inside the last ``w`` values; the peak restarts with each window.

    Stretches of 1, 2, 4, ... rows are summed up from two of half their length, and a window is put together from
    those its length is made of, so a row costs the logarithm of the window and not its length.
    """
    by_pos = Window.partitionBy(*keys, "segment").orderBy("pos")
    one = F.struct(F.col("_nav").alias("hi"), F.col("_nav").alias("lo"), F.lit(0.0).alias("dip"))
    rows = segmented.withColumn("_nav", finite(nav)).withColumns(
        {"_s0": one, **{f"_navs_{w}": F.count("_nav").over(by_pos.rowsBetween(1 - w, 0)) for w in windows}}
    )
    levels = max(windows).bit_length()
    for k in range(1, levels):
        rows = rows.withColumn("_before", F.lag(f"_s{k - 1}", 1 << (k - 1)).over(by_pos))
        rows = rows.withColumn(f"_s{k}", _dips(F.col("_before"), F.col(f"_s{k - 1}")))
    parts, lags = {}, {}
    for w in windows:
        taken, parts[w] = 0, []  # from the present row backwards
        for k in range(levels):
            if w >> k & 1:
                parts[w].append(f"_p{w}_{k}" if taken else f"_s{k}")
                if taken:
                    lags[parts[w][-1]] = F.lag(f"_s{k}", taken).over(by_pos)
                taken += 1 << k
    measured = {f"mdd_{w}": F.when(F.col(f"_navs_{w}") == w, _dip_of(parts[w])) for w in windows}
    scratch = ["_nav", "_before", *lags, *[f"_s{k}" for k in range(levels)], *[f"_navs_{w}" for w in windows]]
    return rows.withColumns(lags).withColumns(measured).drop(*scratch)


def _dip_of(parts: Sequence[str]) -> Column:
    """Deepest dip of stretches in a row, the last one first."""
    dips = [F.col(f"{part}.dip") for part in parts]
    for k in range(1, len(parts)):
        lows = [F.col(f"{part}.lo") for part in parts[:k]]
        dips.append((F.least(*lows) if k > 1 else lows[0]) - F.col(f"{parts[k]}.hi"))
    return F.least(*dips) if len(dips) > 1 else dips[0]


def rolling_max_drawdown(
    df: DataFrame, window: int, keys: Sequence[str] = RUN, nav: str = "nav", block: str | None = None
) -> DataFrame:
    """Add ``max_drawdown`` over the last ``window`` net values."""
    cut = segments(df, keys, daily_order(df), window, block)
    dipped = _add_drawdowns(cut, keys, nav, [window])
    return dipped.filter(~F.col("is_lead")).withColumnRenamed(f"mdd_{window}", "max_drawdown").select(*df.columns, "max_drawdown")


def rolling_metrics(
    df: DataFrame, windows: Sequence[int] = (60, 120), keys: Sequence[str] = RUN, nav: str = "nav", block: str | None = None
) -> DataFrame:
    """Rolling Sharpe and drawdown for several windows, one row per date and window."""
    cut = segments(df, keys, daily_order(df), max(windows), block)
    dipped = _add_drawdowns(cut, keys, nav, windows)
    both = rolling_moments(dipped, keys, return_or_zero(), windows).filter(~F.col("is_lead"))
    per_window = F.array(
        *[
            F.struct(F.lit(w).alias("window"), _sharpe(w).alias("sharpe"), F.col(f"mdd_{w}").alias("max_drawdown"))
            for w in windows
        ]
    )
    return both.select(*keys, "date", F.inline(per_window))


def zscore(
    bars: DataFrame,
    lookback: int = 300,
    keys: Sequence[str] = ("spread",),
    order: Sequence[str] = ("datetime", "row_id"),
    value: str = "close",
    block: str | None = None,
) -> DataFrame:
    """Add ``z``: distance of each value from its window mean, in sample deviations."""
    cut = segments(bars, keys, order, lookback, block)
    moved = rolling_moments(cut, keys, F.col(value).cast("double"), [lookback])
    z = safe_ratio(F.col(value) - F.col(f"mean_{lookback}"), f"std_{lookback}")
    return moved.filter(~F.col("is_lead")).withColumn("z", z).select(*bars.columns, "z")
