from __future__ import annotations

import duckdb
import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def rows():
    """Columns of a given table as tuples."""

    def read(table: str, columns: str) -> list[tuple]:
        return duckdb.sql(f"select {columns} from '{SF_DIR}/{table}.parquet'").fetchall()

    return read


@pytest.fixture(scope="session")
def run(spark):
    """A registered query over the small tables, as a list of rows."""
    from stratlens.llm import queries

    return lambda name: queries.queries()[name](spark, SF_DIR).collect()
