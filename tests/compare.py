"""Compare a registered query with its SQL in DuckDB, the way the contract asks for it."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            connection.execute(
                f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0  # -0.0 is 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def rows_of_spark(df):
    columns = sorted(df.columns)
    return columns, [tuple(plain(row[c]) for c in columns) for row in df.collect()]


def rows_of_duck(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(row[i]) for i in order) for row in result.fetchall()]
    return sorted(names), rows


def key(row):
    return tuple((v is not None, str(type(v).__name__ in ("int", "float")), str(v)) for v in row)


def difference(spark_df, connection, sql):
    """An empty text when both agree."""

    columns, ours = rows_of_spark(spark_df)
    names, theirs = rows_of_duck(connection, sql)
    if columns != names:
        return f"columns {columns} against {names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} against {len(theirs)}: {ours[:3]} against {theirs[:3]}"
    as_number = lambda row: tuple(float(v) if isinstance(v, int) and not isinstance(v, bool)
                                  else v for v in row)
    a, b = sorted(map(as_number, ours), key=key), sorted(map(as_number, theirs), key=key)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, such as {wrong[:2]} in {columns}" if wrong else ""
