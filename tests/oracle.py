"""Side-by-side run of a registered query and its checking SQL."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in RAW:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[_plain(v) for v in table.column(n).to_pylist()] for n in names]
    return sorted(zip(*columns, strict=True), key=repr)


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return "string"
    if pa.types.is_timestamp(kind):
        return "timestamp"
    return str(kind)


def schema(table: pa.Table) -> dict[str, str]:
    return {field.name: _kind(field.type) for field in sorted(table.schema, key=lambda f: f.name)}


def compare(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    """Differences in schema, row count and values; empty when both agree exactly."""
    problems = []
    if schema(spark_table) != schema(duck_table):
        mine, theirs = schema(spark_table), schema(duck_table)
        problems.append(f"schema {set(mine.items()) ^ set(theirs.items())}")
        if sorted(mine) != sorted(theirs):
            return problems
    left, right = _rows(spark_table), _rows(duck_table)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} against {len(right)}")
    only_left = [row for row, other in zip(left, right) if row != other]
    if only_left:
        both = next((a, b) for a, b in zip(left, right) if a != b)
        problems.append(f"{len(only_left)} rows differ, first {both}")
    return problems
