"""Round-trip matching of fills, histograms and density curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratlens.functions.columns import side
from stratlens.operators.joins import SALT, salt_of, salted_join, salts_for
from stratlens.operators.ordered import previous
from stratlens.operators.returns import RUN

SERIES = ["run_id", "instance_id", "spread"]
FILL_ORDER = ["datetime", "row_id"]


def pair_roundtrips(fills: DataFrame, block: str | None = None) -> DataFrame:
    """Match each close with the open it ends, per instance and spread.

    Each side (long, short) has room for one open fill: a second open replaces the first, any fill
    that is not an open closes the opposite side, and a close with nothing open is ignored. So a
    close makes a trade exactly when the fill before it on its side is an open. The traded volume
    is the open's; profit is net of both commissions.
    """
    direction, opens = side("direction"), side("offset") == "OPEN"
    closes = F.when(direction == "SHORT", "LONG").otherwise("SHORT")
    sided = fills.filter(F.col("instance_id").isNotNull() & F.col("spread").isNotNull()).select(
        *SERIES,
        *FILL_ORDER,
        *([block] if block else []),
        opens.alias("_opens"),
        F.when(opens, direction).otherwise(closes).alias("direction"),
        F.col("price").cast("double").alias("price"),
        F.col("volume").cast("int").alias("volume"),
        F.col("commission").cast("double").alias("commission"),
    )
    fill = F.struct("_opens", "datetime", "price", "volume", "commission")
    before = previous(sided, [*SERIES, "direction"], FILL_ORDER, fill, "_open", block)
    trades = before.filter(~F.col("_opens") & F.col("_open._opens"))

    move = F.when(F.col("direction") == "LONG", F.col("price") - F.col("_open.price")).otherwise(
        F.col("_open.price") - F.col("price")
    )
    held = F.timestamp_diff("MICROSECOND", F.col("_open.datetime"), F.col("datetime")) / F.lit(6e7)
    return trades.select(
        *SERIES,
        "direction",
        F.col("_open.datetime").alias("open_time"),
        F.col("datetime").alias("close_time"),
        F.col("_open.price").alias("open_price"),
        F.col("price").alias("close_price"),
        F.col("_open.volume").alias("volume"),
        (F.col("_open.commission") + F.col("commission")).alias("commission"),
        (move * F.col("_open.volume") - F.col("_open.commission") - F.col("commission")).alias("gross_pnl"),
        F.greatest(F.lit(0.0), held).alias("holding_minutes"),
    )


def _bounds(values: DataFrame, keys: Sequence[str], above: float | None) -> DataFrame:
    stats = values.groupBy(*keys).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_rows"), F.stddev_samp("_v").alias("_sd")
    )
    return stats if above is None else stats.filter(F.col("_hi") > above)


def _value_rows(df: DataFrame, value: Column | str, keys: Sequence[str]) -> DataFrame:
    """Just the keys and the value, salted by what else the row holds before that is dropped."""
    column = F.col(value) if isinstance(value, str) else value
    kept = df.select(*keys, column.cast("double").alias("_v"), salt_of(df, keys).alias(SALT))
    return kept.filter(F.col("_v").isNotNull())


def histogram(
    df: DataFrame, value: Column | str, bins: int = 30, keys: Sequence[str] = RUN, above: float | None = None
) -> DataFrame:
    """Equal-width counts between each run's extremes; the last bin includes its upper edge.

    With ``above``, only runs whose largest value exceeds it.
    """
    values = _value_rows(df, value, keys)
    same = F.col("_lo") == F.col("_hi")
    edges = _bounds(values, keys, above).select(
        *keys,
        F.when(same, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_from"),
        F.when(same, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_to"),
    )
    width = (F.col("_to") - F.col("_from")) / bins

    def edge(index: Column) -> Column:
        return F.when(index == bins, F.col("_to")).otherwise(F.col("_from") + index * width)

    guess = F.least(F.floor((F.col("_v") - F.col("_from")) * bins / (F.col("_to") - F.col("_from"))), F.lit(bins - 1))
    # Rounding may put a value next to an edge one bin off; the edges themselves decide.
    down = F.when(F.col("_v") < edge(F.col("_g")), 1).otherwise(0)
    up = F.when((F.col("_g") < bins - 1) & (F.col("_v") >= edge(F.col("_g") + 1)), 1).otherwise(0)
    placed = salted_join(values, edges, keys).withColumn("_g", guess)
    counted = placed.groupBy(*keys, (F.col("_g") - down + up).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    grid = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("_n", F.lit(0)).alias("n"),
    )


def density(
    df: DataFrame,
    value: Column | str,
    points: int = 200,
    bins: int = 30,
    keys: Sequence[str] = RUN,
    above: float | None = None,
) -> DataFrame:
    """Gaussian density on an even grid over each run's range, bandwidth by Scott's rule.

    ``curve`` is the density scaled to the counts of ``histogram``. Equal values are counted first;
    every value adds to every grid point, and the contributions are summed per point before the
    shuffle.
    """
    values = _value_rows(df, value, keys)
    shape = _bounds(values, keys, above).filter("_sd > 0").select(
        *keys,
        "_lo",
        "_rows",
        (F.col("_sd") * F.pow(F.col("_rows").cast("double"), F.lit(-0.2))).alias("_h"),
        ((F.col("_hi") - F.col("_lo")) / (points - 1)).alias("_step"),
    )
    counted = values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_times"))
    dealt = counted.withColumn(SALT, F.pmod(F.xxhash64("_v"), F.lit(salts_for(df))).cast("int"))
    shaped = salted_join(dealt, shape, keys)
    offset = F.col("_v") - F.col("_lo")
    distance = (F.col("point") * F.col("_step") - offset) / F.col("_h")
    every_point = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint")))
    summed = (
        shaped.withColumn("point", every_point)
        .groupBy(*keys, "point")
        .agg(F.sum(F.col("_times") * F.exp(-0.5 * distance * distance)).alias("_k"))
    )
    grid = shape.withColumn("point", every_point)
    height = F.coalesce("_k", F.lit(0.0)) / (F.col("_rows") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))
    bin_width = F.col("_step") * (points - 1) / bins
    return grid.join(summed, [*keys, "point"], "left").select(
        *keys,
        F.col("point").cast("int").alias("point"),
        (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
        height.alias("density"),
        (height * F.col("_rows") * bin_width).alias("curve"),
    )
