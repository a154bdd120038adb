"""Runs a query in Spark and its SQL in DuckDB and compares every row."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pyarrow as pa


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def kind(data_type: pa.DataType) -> str:
    if pa.types.is_string(data_type) or pa.types.is_large_string(data_type):
        return "text"
    if pa.types.is_dictionary(data_type):
        return kind(data_type.value_type)
    return str(data_type)


def sorted_rows(table: pa.Table, names: list[str]) -> list[tuple]:
    """Rows in an order given by their values. Columns that tell rows apart come first."""
    keys = sorted(names, key=lambda name: pa.types.is_floating(table.schema.field(name).type))
    ordered = table.sort_by([(name, "ascending") for name in keys[:12]])
    return list(zip(*(ordered.column(name).to_pylist() for name in names)))


def differences(spark_table: pa.Table, sql_table: pa.Table) -> list[str]:
    names, expected = sorted(spark_table.column_names), sorted(sql_table.column_names)
    if names != expected:
        return [f"columns {names} != {expected}"]
    found = [
        f"type of {name}: {spark_table.schema.field(name).type} != {sql_table.schema.field(name).type}"
        for name in names
        if kind(spark_table.schema.field(name).type) != kind(sql_table.schema.field(name).type)
    ]
    if spark_table.num_rows != sql_table.num_rows:
        found.append(f"rows {spark_table.num_rows} != {sql_table.num_rows}")
        return found
    pairs = zip(sorted_rows(spark_table, names), sorted_rows(sql_table, names))
    unequal = [(a, b) for a, b in pairs if a != b]
    if unequal:
        a, b = unequal[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y][:5]
        found.append(f"{len(unequal)} rows differ, first in {cells}")
    return found
