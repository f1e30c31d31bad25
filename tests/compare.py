"""Comparison of a Spark result with the SQL result on the same tables."""

from __future__ import annotations

from collections.abc import Sequence

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connection(folder: str, tables: Sequence[str] = TABLES) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in tables:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, values as comparable text, in sorted order."""

    def text(value) -> str:
        if value is None or value is pd.NaT or value != value:
            return "NULL"
        if isinstance(value, float):
            return repr(value)
        if isinstance(value, (bool,)):
            return str(value)
        if hasattr(value, "isoformat"):
            return pd.Timestamp(value).isoformat()
        return str(value)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(text, row)) for row in ordered.itertuples(index=False, name=None))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """None when both hold the same columns and rows, else what differs first."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(set(spark_frame.columns) ^ set(sql_frame.columns))}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows, expected {len(sql_frame)}"
    left, right = normal(spark_frame), normal(sql_frame)
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if not wrong:
        return None
    names = sorted(spark_frame.columns)
    a, b = wrong[0]
    cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y]
    return f"{len(wrong)} rows differ, first in {cells[:5]}"
