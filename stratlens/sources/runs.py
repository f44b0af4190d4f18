"""Loading the standard tables of back-test runs from their output folders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratlens import schemas
from stratlens.functions.columns import finite, lenient_timestamp, strict_timestamp
from stratlens.sources.files import cell, escape_glob, glob, other_columns, path_part, place_of, read_records, relative
from stratlens.sources.tables import RunTables, empty_table

# --- fixed values: where a run keeps its tables -------------------------------
PORTFOLIO_FILES = "daily/portfolio/daily_pnl_portfolio_*.csv"
SYMBOL_FILES = "daily/symbol/daily_pnl_*.csv"
TRADE_FILES = "trades/trades.csv"
SIGNAL_FILES = "signals/signals_*.csv"
ROLL_FILES = "rolls/roll_events.csv"
SUMMARY_FILES = "performance/summary.csv"
# ------------------------------------------------------------------------------

STRICT_TIMES = {"date", "datetime", "trading_day", "action_datetime", "bar_datetime"}


def localise(df: DataFrame, headers: Mapping[str, str]) -> DataFrame:
    """Rename the localised columns that are present; others keep their names."""
    return df.withColumnsRenamed({old: new for old, new in headers.items() if old in df.columns})


def _typed(name: str, kind: str) -> Column:
    cell = F.col(f"`{name}`")
    if name == "row_id":
        return cell
    if kind in ("date", "timestamp_ntz"):
        parse = strict_timestamp if name in STRICT_TIMES else lenient_timestamp
        return parse(cell).cast(kind)
    if kind == "double":
        return finite(cell.cast("double"))
    if kind in ("int", "bigint"):
        return finite(cell.cast("double")).cast(kind)
    return cell.cast(kind)


def conform(df: DataFrame, layout: Mapping[str, str]) -> DataFrame:
    """Canonical columns with their types, absent ones NULL, followed by any others as found."""
    known = [
        (_typed(name, kind) if name in df.columns else F.lit(None).cast(kind)).alias(name) for name, kind in layout.items()
    ]
    others = [F.col(f"`{name}`") for name in df.columns if name not in layout]
    return df.select(*known, *others)


def normalize(df: DataFrame, headers: Mapping[str, str], layout: Mapping[str, str]) -> DataFrame:
    """Localised headers renamed, then dates, times and numbers read from their text."""
    return conform(localise(df, headers), layout)


def list_runs(spark: SparkSession, root: str, run_ids: Iterable[str] | None = None) -> list[str]:
    """The runs below ``root``; asking for one that has no folder is an error."""
    found = [relative(spark, root, path) for path in glob(spark, f"{escape_glob(root)}/*", folders=True)]
    if run_ids is None:
        return found
    wanted = list(run_ids)
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise FileNotFoundError(f"no folder for runs {missing} below {root}")
    return wanted


def run_of(pattern: str) -> Column:
    """The run a scanned row belongs to: the folder its file's ``pattern`` starts below."""
    return path_part(pattern.count("/") + 1)


def run_files(spark: SparkSession, root: str, pattern: str, run_ids: Iterable[str]) -> list[str]:
    """Each run's first file, by name, that matches ``pattern``, as patterns that match just these."""
    wanted = set(run_ids)
    alone = next(iter(wanted)) if len(wanted) == 1 else None
    folder = escape_glob(alone) if alone else "*"
    first: dict[str, str] = {}
    for path in glob(spark, f"{escape_glob(root)}/{folder}/{pattern}"):
        run = relative(spark, root, path).split("/")[0]
        if run in wanted:
            first.setdefault(run, path)
    return [escape_glob(path) for path in first.values()]


def _load(
    spark: SparkSession, root: str, run_ids: Iterable[str], name: str, pattern: str, headers: Mapping[str, str], layout: Mapping[str, str]
) -> DataFrame:
    """The layout's columns with their types, absent ones NULL, then all other columns, with types found in the data."""
    files = run_files(spark, root, pattern, run_ids)
    if not files:
        return empty_table(spark, name)
    named = [column for column in layout if column not in ("run_id", "row_id")]
    local = {column: [old for old, new in headers.items() if new == column] for column in named}
    places = {column: place_of(*local[column], column) for column in named}
    records = read_records(spark, files, "run_id", run_of(pattern), places)
    others = other_columns(records, named)
    return normalize(records.select("run_id", *[cell(column).alias(column) for column in named], "row_id", *others), {}, layout)


def load_portfolio(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    return _load(spark, root, run_ids, "portfolio", PORTFOLIO_FILES, schemas.PORTFOLIO_HEADERS, schemas.PORTFOLIO)


def load_symbol_daily(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    return _load(spark, root, run_ids, "symbol", SYMBOL_FILES, schemas.SYMBOL_HEADERS, schemas.SYMBOL)


def load_trades(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    return _load(spark, root, run_ids, "trades", TRADE_FILES, schemas.TRADE_HEADERS, schemas.TRADES)


def load_signals(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    return _load(spark, root, run_ids, "signals", SIGNAL_FILES, {}, schemas.SIGNALS).drop("row_id")


def load_rolls(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    return _load(spark, root, run_ids, "rolls", ROLL_FILES, {}, schemas.ROLLS).drop("row_id")


def load_summary(spark: SparkSession, root: str, run_ids: Iterable[str]) -> DataFrame:
    """Summary rows; the first column of each file is the row label."""

    files = run_files(spark, root, SUMMARY_FILES, run_ids)
    if not files:
        return empty_table(spark, "summary")
    records = read_records(spark, files, "run_id", run_of(SUMMARY_FILES), {"label": F.lit(0)})
    return records.select("run_id", cell("label").alias("label"), *other_columns(records, ["label"]))


def load_runs(spark: SparkSession, root: str, run_ids: Iterable[str] | None = None) -> RunTables:
    """All standard tables of the named runs (all runs by default) as multi-run tables."""
    runs = list_runs(spark, root, run_ids)
    return RunTables.of(
        spark,
        portfolio=load_portfolio(spark, root, runs),
        symbol=load_symbol_daily(spark, root, runs),
        trades=load_trades(spark, root, runs),
        signals=load_signals(spark, root, runs),
        rolls=load_rolls(spark, root, runs),
        summary=load_summary(spark, root, runs),
    )

