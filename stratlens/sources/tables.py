"""The set of tables a group of runs consists of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stratlens import schemas

LAYOUTS = {
    "portfolio": schemas.PORTFOLIO,
    "symbol": schemas.SYMBOL,
    "trades": schemas.TRADES,
    "signals": schemas.SIGNALS,
    "rolls": schemas.ROLLS,
    "summary": schemas.SUMMARY,
    "capital_curves": schemas.CAPITAL_CURVES,
    "ic_summary": schemas.IC_SUMMARY,
    "synthesis_summary": schemas.SYNTHESIS_SUMMARY,
    "feature_importance": schemas.FEATURE_IMPORTANCE,
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], schemas.ddl(LAYOUTS[name]))


@dataclass
class RunTables:
    """One DataFrame per table, each holding all runs; a table nobody wrote is empty but typed."""

    portfolio: DataFrame
    symbol: DataFrame
    trades: DataFrame
    signals: DataFrame
    rolls: DataFrame
    summary: DataFrame
    capital_curves: DataFrame
    ic_summary: DataFrame
    synthesis_summary: DataFrame
    feature_importance: DataFrame
    # Columns that cut over-long daily series into pieces, see ``operators.ordered``.
    portfolio_block: str | None = None
    symbol_block: str | None = None
    # Tables that several reports need, made once (``reports.share``); where missing, each report makes its own.
    totals: DataFrame | None = None
    cells: DataFrame | None = None
    matched: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> RunTables:
        unknown = set(tables) - set(LAYOUTS)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        return cls(**{name: tables[name] if name in tables else empty_table(spark, name) for name in LAYOUTS})
