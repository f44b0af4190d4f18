"""Writing report datasets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame

from stratlens.sources.files import remove_folder, run_folder_files
from stratlens.sources.tables import LAYOUTS, RunTables


# Within a run's files rows follow those of these columns that a dataset has, in this order.
SORT = (
    "strategy", "series", "rank", "pick", "sector", "axis", "kind", "window", "date", "spread", "symbol", "datetime", "action_datetime",
    "tradingday", "open_time", "time", "year", "month", "ym", "month_end", "point", "bin", "s1", "s2", "row_id",
)
SORT_FIRST = {"trades": ("spread", "datetime"), "signals": ("symbol", "action_datetime"), "symbol": ("date", "spread")}


def write_report(
    df: DataFrame, path: str, mode: str = "overwrite", first: Sequence[str] = (), runs: Iterable[str] | None = None
) -> None:
    """One Parquet dataset per report, foldered by run and sorted within each file.

    Rebalancing on the run keeps files few per run, and splits a run that is far larger than the
    others over several writers. Overwriting replaces the folders of the runs that df holds and
    leaves other runs alone; ``clear_report`` empties a whole dataset. ``runs`` names the runs that
    were computed: one that df has no rows of is emptied too, after the others are in place. Such a run is one whose
    folder still holds a file from before, so no further job looks for it.
    """
    spark = df.sparkSession
    covered = list(runs or ()) if mode == "overwrite" else []
    before = {run: run_folder_files(spark, path, run) for run in covered}
    order = [c for c in dict.fromkeys(["run_id", *first, *SORT]) if c in df.columns]
    rows = df.hint("rebalance", "run_id").sortWithinPartitions(*order)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
    for run, files in before.items():
        if files & run_folder_files(spark, path, run):
            remove_folder(spark, path, run)


def clear_report(df: DataFrame, path: str) -> None:
    """Replace a whole dataset, all runs, by what df holds."""
    order = [c for c in ["run_id", *SORT] if c in df.columns]
    rows = df.hint("rebalance", "run_id").sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("run_id").parquet(path)


def write_reports(
    reports: Mapping[str, DataFrame], root: str, mode: str = "overwrite", runs: Iterable[str] | None = None
) -> list[str]:
    """Every report below ``root``; a run of ``runs`` that a report has no rows of loses its earlier ones."""
    covered = None if runs is None else list(runs)
    for name, df in reports.items():
        write_report(df, f"{root}/{name}", mode, runs=covered)
    return [f"{root}/{name}" for name in reports]


def stage_tables(tables: RunTables, root: str) -> RunTables:
    """Write the tables as Parquet below ``root`` and return them read back.

    Reports then read only the columns they use instead of parsing every CSV again, and a
    condition on the run reads only that run's folder.
    """
    staged = {}
    for name in LAYOUTS:
        source = getattr(tables, name)
        if source.columns == ["run_id"]:
            continue  # a table nobody wrote
        write_report(source, f"{root}/{name}", first=SORT_FIRST.get(name, ()))
        # Partition values are read back as text, so a run named 007 keeps its name.
        staged[name] = source.sparkSession.read.schema(source.schema).parquet(f"{root}/{name}")
    return replace(tables, **staged)
