"""Loading equity-research runs: capital curves and factor side tables."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratlens.functions.columns import finite, strict_timestamp
from stratlens.operators.returns import capital_to_portfolio, first_strategy
from stratlens.sources.files import cell, escape_glob, glob, is_dir, last_place, other_columns, place_of, read_records, read_wide
from stratlens.sources.runs import list_runs, run_files, run_of
from stratlens.sources.tables import RunTables, empty_table

# --- fixed values: file names of an equity run ---------------------------------
CAPITAL_FILE = "capital_curves.csv"
IC_FILE = "ic_summary.csv"
SYNTHESIS_FILE = "synthesis_comparison_summary.csv"
IMPORTANCE_FILE = "feature_importance.csv"
# ------------------------------------------------------------------------------


def _number(text: Column) -> Column:
    return finite(text.cast("double"))


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit("nan"))


def _curves(spark: SparkSession, files: Sequence[str], owner_of: Column) -> DataFrame:
    """Capital curves, one row per date and strategy, with the column's place among a file's strategies.

    Files without a date column have none.
    """
    if not files:
        return empty_table(spark, "capital_curves")
    cells = read_wide(read_records(spark, files, "run_id", owner_of), "run_id")
    row = Window.partitionBy("path", "row_id")
    dated = cells.withColumns(
        {
            "date": F.max(F.when(F.col("name") == "date", F.col("cell"))).over(row),
            "date_place": F.max(F.when(F.col("name") == "date", F.col("place"))).over(row),
        }
    ).where("date_place is not null and name <> 'date'")
    place = F.col("place") - (F.col("place") > F.col("date_place")).cast("int")
    return dated.select(
        "run_id", strict_timestamp("date").cast("date").alias("date"), F.col("name").alias("strategy"),
        place.cast("int").alias("col_pos"), _number(F.col("cell")).alias("capital"),
    )


def _information(records: DataFrame) -> DataFrame:
    return records.select("run_id", _text(cell("factor")).alias("factor"), _number(cell("ic_mean")).alias("ic_mean"))


def _synthesis(records: DataFrame) -> DataFrame:
    return records.select("run_id", _text(cell("label")).alias("label"), _number(cell("value")).alias("value"))


def _importance(records: DataFrame) -> DataFrame:
    return records.select("run_id", *other_columns(records, []))


def load_equity_runs(
    spark: SparkSession,
    root: str,
    run_ids: Iterable[str] | None = None,
    strategy: str = "",
    initial_capital: float = 10000.0,
) -> RunTables:
    """Equity runs as run tables, each run's portfolio made from one of its capital curves.

    The curve is ``strategy``, or each run's first. If ``root`` has no folder for a single
    requested run, ``root`` itself is taken as that run and named after its folder.
    """
    at_root = None
    wanted = None if run_ids is None else list(run_ids)
    if wanted is not None and len(wanted) == 1 and not is_dir(spark, f"{root}/{wanted[0]}"):
        if not is_dir(spark, root):
            raise FileNotFoundError(f"no run folder {root}")
        at_root = posixpath.basename(root.rstrip("/"))
    runs = [] if at_root else list_runs(spark, root, wanted)

    def files_of(name: str) -> list[str]:
        if at_root:
            return [escape_glob(path) for path in glob(spark, f"{escape_glob(root)}/{name}")]
        return run_files(spark, root, name, runs)

    def load(table: str, name: str, shape: Callable[[DataFrame], DataFrame], places: Mapping[str, Column]) -> DataFrame:
        files = files_of(name)
        return shape(read_records(spark, files, "run_id", run_of(name), places)) if files else empty_table(spark, table)

    information = {"factor": F.coalesce(place_of("factor"), F.lit(0)), "ic_mean": F.coalesce(place_of("ic_mean"), last_place())}
    synthesis = {"label": F.lit(0), "value": last_place()}
    curves = _curves(spark, files_of(CAPITAL_FILE), run_of(CAPITAL_FILE))
    chosen = curves if strategy else first_strategy(curves)
    return RunTables.of(
        spark,
        portfolio=capital_to_portfolio(chosen, initial_capital, strategy),
        capital_curves=curves,
        ic_summary=load("ic_summary", IC_FILE, _information, information),
        synthesis_summary=load("synthesis_summary", SYNTHESIS_FILE, _synthesis, synthesis),
        feature_importance=load("feature_importance", IMPORTANCE_FILE, _importance, {}),
    )
