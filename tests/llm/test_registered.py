"""Registered queries and the SQL of those that have one."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from stratlens.llm import queries
from tests import oracle
from tests.llm.conftest import SF_DIR

TABLES = ("documents", "embeddings", "pages", "benchmark")


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    got = queries.queries()[name](spark, SF_DIR).toArrow()
    assert oracle.compare(got, con.sql(queries.oracle_sql()[name]).to_arrow_table()) == []
