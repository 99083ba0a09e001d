"""Compare a registered query with its SQL: column names, rows and values."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"create view {table.stem} as select * from read_parquet('{table}')")
    return connection


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


_SQL_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def differences(frame, sql: str, connection) -> str:
    """Empty if both give the same columns and the same rows."""
    result = connection.execute(sql)
    sql_columns = [column[0] for column in result.description]
    if sorted(frame.columns) != sorted(sql_columns):
        return f"columns {sorted(frame.columns)} != {sorted(sql_columns)}"
    kinds = {column[0]: str(column[1]) for column in result.description}
    for name, kind in frame.dtypes:
        if _SQL_TYPES.get(kind) != kinds[name]:
            return f"column {name} is {kind}, in SQL {kinds[name]}"
    expected = _rows(sql_columns, result.fetchall())
    actual = _rows(frame.columns, frame.collect())
    if actual == expected:
        return "" if expected else "no rows on either side"
    extra, missing = actual - expected, expected - actual
    return (
        f"{sum(actual.values())} rows, expected {sum(expected.values())}; "
        f"not expected: {list(extra)[:3]}; missing: {list(missing)[:3]}"
    )
