"""Operators over a run's spreads: totals, rankings, picks, correlation and sectors.

Rankings and picks follow per-spread totals, so they see one row per run and spread. Every
single-rank filter keeps its own ``row_number`` so Spark cuts each map task to the first n rows
per run before the shuffle. Equal totals are ordered by spread name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import is_active, month_label, product_prefix, return_or_zero
from stratlens.operators.returns import net_value, portfolio_nav

PORTFOLIO_SERIES = "portfolio"


def _total(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def spread_totals(symbol: DataFrame) -> DataFrame:
    """Profit, commission and active-day profit per run and spread, in one pass."""
    active = is_active("daily_pnl")
    return (
        symbol.filter(F.col("spread").isNotNull())
        .groupBy("run_id", "spread")
        .agg(
            _total("daily_pnl").alias("pnl"),
            _total("commission").alias("commission"),
            _total(F.when(active, F.col("daily_pnl"))).alias("active_pnl"),
            F.count_if(active).alias("active_rows"),
        )
    )


def spread_cumulative_pnl(symbol: DataFrame) -> DataFrame:
    return spread_totals(symbol).select("run_id", "spread", "pnl")


def _first_n(totals: DataFrame, n: int, *order: Column, name: str = "rank") -> DataFrame:
    by_run = Window.partitionBy("run_id").orderBy(*order)
    return totals.withColumn(name, F.row_number().over(by_run)).filter(F.col(name) <= n)


def _best(totals: DataFrame, n: int) -> DataFrame:
    return _first_n(totals, n, F.col("pnl").desc(), F.col("spread").asc())


def _worst(totals: DataFrame, n: int) -> DataFrame:
    return _first_n(totals, n, F.col("pnl").asc(), F.col("spread").desc())


def _numbered(candidates: DataFrame) -> DataFrame:
    """Drop repeats, keeping the earliest place, and number what is left per run."""
    unique = candidates.groupBy("run_id", "spread").agg(F.min("_place").alias("_place"), F.first("pnl").alias("pnl"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("_place"))
    return unique.select("run_id", "spread", "pnl", place.alias("pick"))


def _ends(totals: DataFrame, n: int) -> DataFrame:
    best = _best(totals, n).select("run_id", "spread", "pnl", F.col("rank").alias("_place"))
    worst = _worst(totals, n).select("run_id", "spread", "pnl", (2 * n + 1 - F.col("rank")).alias("_place"))
    return best.unionByName(worst)


def top_bottom_spreads(totals: DataFrame, n: int = 10) -> DataFrame:
    """The n best and n worst spreads of each run, in descending order of profit."""
    return _numbered(_ends(totals, n))


def diagnostic_spreads(totals: DataFrame, n: int = 5) -> DataFrame:
    """The n best, n worst and first n spreads with a profit of exactly zero."""
    zero = _first_n(totals.filter("pnl = 0"), n, F.col("spread").asc())
    placed = zero.select("run_id", "spread", "pnl", (2 * n + F.col("rank")).alias("_place"))
    return _numbered(_ends(totals, n).unionByName(placed))


def largest_spreads(totals: DataFrame, n: int = 20) -> DataFrame:
    """The n spreads of largest absolute profit, zero excluded."""
    return _first_n(totals.filter("pnl <> 0"), n, F.abs("pnl").desc(), F.col("spread").asc())


def ranked_spreads(totals: DataFrame, n: int = 30) -> DataFrame:
    """The n most profitable spreads."""
    return _best(totals, n)


def active_spreads(totals: DataFrame, n: int = 50) -> DataFrame:
    """The n spreads of largest absolute active-day profit; runs with fewer than two have none."""
    picks = _first_n(totals.filter("active_rows > 0"), n, F.abs("active_pnl").desc(), F.col("spread").asc())
    many = F.count(F.lit(1)).over(Window.partitionBy("run_id")) >= 2
    return picks.withColumn("_many", many).filter("_many").drop("_many")


def spread_nav(symbol: DataFrame, block: str | None = None) -> DataFrame:
    """Additive net value of every spread."""
    return net_value(symbol.filter(F.col("spread").isNotNull()), ("run_id", "spread"), "nav", block)


def spread_nav_picks(
    symbol: DataFrame,
    portfolio: DataFrame,
    n: int = 10,
    symbol_block: str | None = None,
    portfolio_block: str | None = None,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Net value of the best and worst spreads next to the whole portfolio's."""
    picks = top_bottom_spreads(_or_totals(totals, symbol), n).select("run_id", "spread")
    chosen = symbol.join(picks, ["run_id", "spread"], "left_semi")
    spreads = spread_nav(chosen, symbol_block).select(
        "run_id", F.col("spread").alias("series"), "date", "nav", F.lit(False).alias("is_portfolio")
    )
    whole = portfolio_nav(portfolio, block=portfolio_block).select(
        "run_id", F.lit(PORTFOLIO_SERIES).alias("series"), "date", "nav", F.lit(True).alias("is_portfolio")
    )
    return spreads.unionByName(whole.join(picks.select("run_id"), "run_id", "left_semi"))


def spread_month_matrix(symbol: DataFrame, n: int = 20, totals: DataFrame | None = None) -> DataFrame:
    """Monthly return of the largest spreads, over every month any of them traded (else zero)."""
    picks = largest_spreads(_or_totals(totals, symbol), n).select("run_id", "spread")
    monthly = (
        symbol.filter(F.col("date").isNotNull())
        .join(picks, ["run_id", "spread"])
        .groupBy("run_id", "spread", month_label().alias("ym"))
        .agg(F.sum(return_or_zero()).alias("ret"))
    )
    # At most n spreads per run, each with one entry per calendar month.
    line = F.map_from_entries(F.collect_list(F.struct("ym", "ret")))
    lines = monthly.groupBy("run_id", "spread").agg(line.alias("line"))
    runs = lines.groupBy("run_id").agg(
        F.collect_list(F.struct("spread", "line")).alias("lines"),
        F.array_distinct(F.flatten(F.collect_list(F.map_keys("line")))).alias("months"),
    )
    cells = runs.select("run_id", "months", F.inline("lines")).select("run_id", "spread", "line", F.explode("months").alias("ym"))
    ret = F.coalesce(F.try_element_at("line", F.col("ym")), F.lit(0.0))
    return cells.select("run_id", "spread", "ym", ret.alias("ret"))


def active_spreads_per_day(symbol: DataFrame) -> DataFrame:
    """Number of spreads with a profit other than zero, per run and date that has any."""
    active = symbol.filter(is_active("daily_pnl") & F.col("date").isNotNull())
    return active.groupBy("run_id", "date").agg(F.count_distinct("spread").alias("active_spreads"))


def activity(portfolio: DataFrame, symbol: DataFrame) -> DataFrame:
    """Trades, universe size and active spreads on every portfolio date."""
    counted = portfolio.join(active_spreads_per_day(symbol), ["run_id", "date"], "left")
    return counted.select(
        "run_id", "date", "num_trades", "num_spreads", F.coalesce("active_spreads", F.lit(0)).alias("active_spreads")
    )


def fill_counts(fills: DataFrame) -> DataFrame:
    return fills.filter(F.col("spread").isNotNull()).groupBy("run_id", "spread").agg(F.count(F.lit(1)).alias("trades"))


def spread_contribution(symbol: DataFrame, fills: DataFrame, n: int = 30, totals: DataFrame | None = None) -> DataFrame:
    """The most profitable spreads with their fill counts and commissions."""
    ranked = ranked_spreads(_or_totals(totals, symbol), n)
    joined = ranked.join(fill_counts(fills), ["run_id", "spread"], "left")
    return joined.select(
        "run_id", "rank", "spread", "pnl", F.coalesce("trades", F.lit(0)).alias("trades"), "commission", (F.col("pnl") >= 0).alias("is_gain")
    )


def _or_totals(totals: DataFrame | None, symbol: DataFrame) -> DataFrame:
    """Totals made before, or the symbol table's."""
    return spread_totals(symbol) if totals is None else totals


def pick_cells(symbol: DataFrame, n: int = 50, totals: DataFrame | None = None) -> DataFrame:
    """Summed return per run, date and picked spread, with the pick's number."""
    picks = active_spreads(_or_totals(totals, symbol), n).select("run_id", "spread", F.col("rank").alias("pick"))
    return (
        symbol.filter(F.col("date").isNotNull())
        .join(picks, ["run_id", "spread"])
        .groupBy("run_id", "date", "pick", "spread")
        .agg(_total(F.col("daily_pnl_pct").cast("double")).alias("ret"))
    )


def spread_correlation(symbol: DataFrame, n: int = 50, totals: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Pearson correlation of the picked spreads' daily returns; a day without a row is zero.

    The cells are read once. Each date's at most ``n`` returns become one vector with a place for every pick, and the
    vectors are turned into one per pick, centred, as long as the run has dates. A run's matrix is then the
    products of its at most ``n`` vectors, so no row per date and pair is made. A spread whose return never
    changes has no correlation.
    """
    cells = pick_cells(symbol, n, totals) if cells is None else cells
    packed = cells.groupBy("run_id", "date").agg(F.map_from_entries(F.collect_list(F.struct("pick", F.struct("spread", "ret")))).alias("row"))
    every_pick = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda pick: F.try_element_at("row", pick))
    lines = (
        packed.select("run_id", "date", F.posexplode(every_pick).alias("place", "cell"))
        .groupBy("run_id", "place")
        .agg(
            F.max("cell.spread").alias("spread"),
            F.array_sort(F.collect_list(F.struct("date", F.coalesce("cell.ret", F.lit(0.0)).alias("ret")))).getField("ret").alias("rets"),
            F.avg(F.coalesce("cell.ret", F.lit(0.0))).alias("mean"),
        )
        .where("spread is not null")
    )
    centred = lines.select(
        "run_id", "place", "spread", F.transform("rets", lambda r: r - F.col("mean")).alias("v"),
        (F.array_min("rets") < F.array_max("rets")).alias("varies"),
    )
    measured = centred.withColumn("norm", F.when(F.col("varies"), F.sqrt(_dot("v", "v"))))
    picks = measured.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("place", "spread", "norm", "v"))).alias("picks"))
    left = picks.select("run_id", "picks", F.posexplode("picks").alias("at", "a"))
    pairs = left.select("run_id", "a", F.explode(F.slice("picks", F.col("at") + 1, n)).alias("b"))
    norms = F.col("a.norm") * F.col("b.norm")
    own = F.col("a.place") == F.col("b.place")
    corr = F.when(norms > 0, F.when(own, F.lit(1.0)).otherwise(_dot("a.v", "b.v") / norms))
    both = pairs.select("run_id", F.col("a.spread").alias("s1"), F.col("b.spread").alias("s2"), corr.alias("corr"), own.alias("_own"))
    ways = F.array(F.struct("s1", "s2"), F.struct(F.col("s2").alias("s1"), F.col("s1").alias("s2")))
    return both.select("run_id", "corr", F.inline(F.when(F.col("_own"), F.slice(ways, 1, 1)).otherwise(ways))).select("run_id", "s1", "s2", "corr")


def _dot(a: str, b: str) -> Column:
    """Sum of the products of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, product: total + product)


def active_spread_count(symbol: DataFrame, n: int = 50, totals: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """How many of the picked spreads had a return other than zero on each date."""
    cells = pick_cells(symbol, n, totals) if cells is None else cells
    return cells.groupBy("run_id", "date").agg(F.count_if(F.col("ret") != 0).alias("n"))


def sector_pnl(symbol: DataFrame) -> DataFrame:
    """Profit per sector; a sector is the product of a spread's first leg."""
    return symbol.groupBy("run_id", product_prefix("spread").alias("sector")).agg(_total("daily_pnl").alias("pnl"))


def sector_daily_pnl(symbol: DataFrame) -> DataFrame:
    by_sector = symbol.filter(F.col("date").isNotNull()).groupBy("run_id", "date", product_prefix("spread").alias("sector"))
    return by_sector.agg(_total("daily_pnl").alias("pnl"))


def sector_box(symbol: DataFrame) -> DataFrame:
    """Box-plot figures of each sector's daily profit; whiskers end at the last value within
    1.5 interquartile ranges of the box. One row per run, sector and date goes in, so a box sees
    at most one value per calendar day."""
    box = Window.partitionBy("run_id", "sector")
    quartiles = F.percentile("pnl", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(box)
    daily = sector_daily_pnl(symbol).withColumn("_q", quartiles)
    boxed = daily.select("run_id", "sector", "pnl", *[F.col("_q")[i].alias(q) for i, q in enumerate(("q1", "med", "q3"))])
    reach = (F.col("q3") - F.col("q1")) * 1.5
    above = F.when(F.col("pnl") >= F.col("q1") - reach, F.col("pnl"))
    below = F.when(F.col("pnl") <= F.col("q3") + reach, F.col("pnl"))
    return boxed.groupBy("run_id", "sector", "q1", "med", "q3").agg(
        F.least(F.min(above), F.col("q1")).alias("whislo"), F.greatest(F.max(below), F.col("q3")).alias("whishi")
    )
