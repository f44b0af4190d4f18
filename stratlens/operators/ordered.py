"""Running totals, previous-row lookup and row positions over series of any length.

A series is the set of rows sharing ``keys``, sorted by ``order``. One row per key and calendar
day keeps a series short whatever the input size, and then a single window per key is the right
plan. Fills and bars have no such bound: ``range_blocks`` adds a ``block`` column that cuts every
series at a calendar unit and, inside it, at cut points taken from the rows' own sort keys, so that
a key with very many rows in one unit, at one instant or without a time is several pieces. The
functions below run per piece and carry only one summary row per piece across the cuts. The plan
is the same for every size, and building it runs no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlens.operators.joins import salted_join

BLOCK = "block"
PIECE = 1 << 17  # rows of a piece, on average
_STEPS = 20  # a unit has fewer than 2 ** _STEPS cut points


def _sorted_by(order: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in order]


def _last_of(order: Sequence[str]) -> Column:
    """Largest for the row that the windows sort last: missing values after all others."""
    return F.struct(*[c for name in order for c in (F.col(name).isNull(), F.col(name))])


def _series(keys: Sequence[str], order: Sequence[str], block: str | None):
    return Window.partitionBy(*keys, *([block] if block else [])).orderBy(*_sorted_by(order))


def _cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Sorted cut points of each key and unit: the sort keys of about one row in ``size``.

    The rows are chosen by a hash of keys and sort key, so a task that runs again, or another
    branch of a plan, finds the same ones.
    """
    chosen = df.where(F.pmod(F.xxhash64(*keys, *order), F.lit(size)) == 0)
    return chosen.groupBy(*keys, "_unit").agg(F.array_sort(F.collect_set(_last_of(order))).alias("_cuts"))


def cuts_before(cuts: Column, row: Column) -> Column:
    """How many of the sorted cut points are not behind the row, by binary search."""
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(_STEPS))])

    def step(found: Column, power: Column) -> Column:
        ahead = found + power
        return F.when((ahead <= F.size(cuts)) & (F.get(cuts, ahead - 1) <= row), ahead).otherwise(found)

    return F.when(cuts.isNull(), 0).otherwise(F.aggregate(powers, F.lit(0), step))


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], unit: str, size: int = PIECE) -> DataFrame:
    """Add ``block``: the calendar ``unit`` of the first sort column and the piece of it, which sort like the rows.

    Pieces hold about ``size`` rows of one key, however many rows it has in a unit or without a time. Rows are told apart
    by ``order`` only, so rows equal in all of it share a piece. A key's cut points reach its rows by a salted join.
    """
    dated = calendar_blocks(df, order, unit).withColumnRenamed(BLOCK, "_unit")
    cuts = _cut_points(dated.select(*keys, *[c for c in order if c not in keys], "_unit"), keys, order, size)
    joined = salted_join(dated, cuts, [*keys, "_unit"], "left")
    piece = cuts_before(F.col("_cuts"), _last_of(order))
    return joined.withColumn(BLOCK, F.struct(F.col("_unit").alias("unit"), piece.alias("piece"))).drop("_unit", "_cuts")


def calendar_blocks(df: DataFrame, order: Sequence[str], unit: str) -> DataFrame:
    """Add ``block``, the start of the calendar ``unit`` (year, month, day, hour) of the first sort column.

    Right where the rows of one key in a unit fit a task; ``range_blocks`` cuts further. Missing times
    sort last, so they get a last block of their own.
    """
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    return df.withColumn(BLOCK, F.coalesce(F.date_trunc(unit, F.col(order[0])).cast("timestamp_ntz"), far))


def cumulative(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    outputs: Mapping[str, tuple[str, Column]],
    block: str | None = None,
) -> DataFrame:
    """Add running sums and maxima, ``outputs = {name: ("sum" | "max", column)}``.

    A missing input leaves a missing output on its own row and is skipped afterwards.
    """
    combine = {"sum": F.sum, "max": F.max}
    upto = _series(keys, order, block).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inputs = df.withColumns({f"_in_{name}": value for name, (_, value) in outputs.items()})
    local = inputs.withColumns(
        {name: combine[kind](f"_in_{name}").over(upto) for name, (kind, _) in outputs.items()}
    )
    if block:
        totals = inputs.groupBy(*keys, block).agg(
            *[combine[kind](f"_in_{name}").alias(f"_total_{name}") for name, (kind, _) in outputs.items()]
        )
        before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select(
            *keys,
            block,
            *[combine[kind](f"_total_{name}").over(before).alias(f"_carry_{name}") for name, (kind, _) in outputs.items()],
        )
        local = local.join(carried, [*keys, block], "left").withColumns(
            {name: _merge(kind, F.col(name), F.col(f"_carry_{name}")) for name, (kind, _) in outputs.items()}
        )
        local = local.drop(*[f"_carry_{name}" for name in outputs])
    kept = local.withColumns(
        {name: F.when(F.col(f"_in_{name}").isNotNull(), F.col(name)) for name in outputs}
    )
    return kept.drop(*[f"_in_{name}" for name in outputs])


def _merge(kind: str, here: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(here, carried)
    return F.coalesce(here, F.lit(0.0)) + F.coalesce(carried, F.lit(0.0))


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, block: str | None = None
) -> DataFrame:
    """Add ``value`` of the row before, within each series."""
    series = _series(keys, order, block)
    if not block:
        return df.withColumn(name, F.lag(value).over(series))
    lasts = df.groupBy(*keys, block).agg(F.max_by(value, _last_of(order)).alias("_last"))
    carried = lasts.select(
        *keys, block, F.lag("_last").over(Window.partitionBy(*keys).orderBy(block)).alias("_carry")
    )
    local = df.withColumns({name: F.lag(value).over(series), "_first": F.row_number().over(series) == 1})
    joined = local.join(carried, [*keys, block], "left")
    picked = joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name)))
    return picked.drop("_first", "_carry")


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", block: str | None = None
) -> DataFrame:
    """Add the 1-based place of each row in its series."""
    local = df.withColumn(name, F.row_number().over(_series(keys, order, block)).cast("bigint"))
    if not block:
        return local
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    carried = counts.select(*keys, block, F.sum("_n").over(before).alias("_carry"))
    joined = local.join(carried, [*keys, block], "left")
    return joined.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")


def segments(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    block: str | None = None,
    length: int = 4096,
) -> DataFrame:
    """Cut series into equal ``segment``s, each led by a copy of the ``reach`` rows before it.

    Sliding frames up to ``reach + 1`` rows are then complete inside a segment for every row that
    is not a copy (``is_lead`` false), and no task ever holds more than one segment per window.
    """
    length = max(length, reach)
    placed = position(df, keys, order, "pos", block)
    index = F.col("pos") - 1
    own = F.struct(F.floor(index / length).alias("segment"), F.lit(False).alias("is_lead"))
    lead = F.struct((F.floor(index / length) + 1).alias("segment"), F.lit(True).alias("is_lead"))
    homes = F.when(index % length >= length - reach, F.array(own, lead)).otherwise(F.array(own))
    return placed.withColumn("_home", F.explode(homes)).select("*", "_home.segment", "_home.is_lead").drop("_home")
