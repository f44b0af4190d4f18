"""Loading market bars of many spreads from yearly folders."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import lenient_double, spread_pair_folder, spread_product, strict_timestamp
from stratlens.schemas import BARS, ddl
from stratlens.sources.files import cell, escape_glob, is_dir, matching, path_part, place_of, qualified, read_records

MARKET_FOLDER = "MarketData"


def bar_places(files: DataFrame, root: str) -> DataFrame:
    """Add to rows with a ``path`` below ``root`` its ``year`` and ``precedence`` (0 is best); rows of other layouts go.

    A spread's file lies below its year in ``product/product``, ``product`` or the pair's folder,
    looked up in that order below the market folder and then below ``root`` itself.
    """
    below = F.substring(F.regexp_replace("path", "^[a-zA-Z0-9]+:(//[^/]*)?", ""), F.lit(len(root) + 2), F.length("path"))
    market = F.startswith(below, F.lit(f"{MARKET_FOLDER}/"))
    pieces = F.split(F.when(market, F.substring(below, F.lit(len(MARKET_FOLDER) + 2), F.length("path"))).otherwise(below), "/")
    folder = F.array_join(F.slice("_pieces", F.lit(2), F.size("_pieces") - 2), "/")
    product, pair = spread_product("spread"), spread_pair_folder("spread")
    layout = (
        F.when(F.col("_folder") == F.concat(product, F.lit("/"), product), 0)
        .when(F.col("_folder") == product, 1)
        .when(F.col("_folder") == pair, 2)
    )
    named = files.withColumns({"_pieces": pieces, "_rank": F.when(market, 0).otherwise(3)}).withColumn("_folder", folder)
    known = named.withColumns({"year": F.get("_pieces", F.lit(0)), "precedence": F.col("_rank") + layout})
    return known.where("precedence is not null").drop("_pieces", "_rank", "_folder")


def chosen_files(files: DataFrame) -> DataFrame:
    """The rows of one file per spread and year: the one of best precedence."""
    best = F.min("precedence").over(Window.partitionBy("spread", "year"))
    return files.withColumn("_best", best).where("precedence = _best").drop("_best")


def load_bars(
    spark: SparkSession, root: str, years: Iterable[str], spreads: DataFrame | Iterable[str] | None = None
) -> DataFrame:
    """Bars ``spread, datetime, close, row_id`` of the wanted spreads (all by default).

    A spread's close is ``close_price`` if any of its yearly files has that column, else
    ``close``; rows whose close is not a number are left out. Which files count, and which column, is settled on the
    executors from one row per file; Spark lists the files, and a list of spreads narrows what it lists.
    """
    bases = [f"{root}/{MARKET_FOLDER}"] if is_dir(spark, f"{root}/{MARKET_FOLDER}") else []
    wanted = None if spreads is None or isinstance(spreads, DataFrame) else list(dict.fromkeys(spreads))
    names = ["*"] if wanted is None else [escape_glob(name) for name in wanted]
    patterns = matching(
        spark,
        [
            f"{escape_glob(base)}/{escape_glob(year)}/{folders}/{name}.csv"
            for base in [*bases, root] for year in dict.fromkeys(str(y) for y in years) for folders in ("*", "*/*") for name in names
        ],
    )
    if not patterns:
        return spark.createDataFrame([], ddl(BARS))

    def choose(files: DataFrame) -> DataFrame:
        if isinstance(spreads, DataFrame):
            files = files.join(spreads.select("spread").distinct(), "spread", "left_semi")
        return chosen_files(bar_places(files, qualified(spark, root)))

    priced = F.max(place_of("close_price").isNotNull()).over(Window.partitionBy("spread"))
    places = {"datetime": place_of("datetime"), "close": F.when(priced, place_of("close_price")).otherwise(place_of("close"))}
    records = read_records(spark, patterns, "spread", _spread_of_path(), places, choose)
    time, close = strict_timestamp(cell("datetime")), lenient_double(cell("close"))
    bars = records.select("spread", time.alias("datetime"), close.alias("close"), "row_id")
    return bars.where(F.col("close").isNotNull())


def _spread_of_path() -> Column:
    return F.regexp_replace(path_part(0), r"\.csv$", "")
