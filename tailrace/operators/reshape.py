"""Column choice, reshaping and last rows."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def held_counts(columns: Sequence[str]) -> list[Column]:
    """Aggregates that tell which columns hold a value: the number of rows, and of values by column."""
    return [F.count(F.lit(1)).alias("rows of the table"), *[F.count(F.col(f"`{c}`")).alias(c) for c in columns]]


def drop_all_null_columns(rows: DataFrame, counts: Row | None = None) -> DataFrame:
    """Columns that hold at least one value. One pass counts all columns, or counts has held_counts() of
    them, as a stored table gives them without a pass; the driver gets one row. Without rows there is nothing
    to judge by, and all columns stay."""
    total, *held = counts or rows.agg(*held_counts(rows.columns)).first()
    return rows.select(*[f"`{c}`" for c, n in zip(rows.columns, held) if n or not total])


def starting_with(rows: DataFrame, prefix: str, but: bool = False) -> list[str]:
    """Columns whose name starts with prefix, or with but=True all others."""
    return [c for c in rows.columns if c.startswith(prefix) != but]


def relocate(columns: Sequence[str], column: str, after: str) -> list[str]:
    """Column order with one column moved behind another."""
    order = [c for c in columns if c != column]
    order.insert(order.index(after) + 1, column)
    return order


def clean_name(name: str) -> str:
    """Snake case in ASCII: 'Total produksjon' -> 'total_produksjon'."""
    letters = name.translate(str.maketrans("øØæÆåÅ", "oOaAaA"))
    ascii_name = unicodedata.normalize("NFKD", letters).encode("ascii", "ignore").decode()
    split = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", ascii_name)
    snake = re.sub(r"[^A-Za-z0-9]+", "_", split).strip("_").lower()
    return f"x{snake}" if snake[:1].isdigit() else snake


def clean_names(rows: DataFrame) -> DataFrame:
    """All columns in snake case; repeated names get a number."""
    seen: dict[str, int] = {}
    names = []
    for name in map(clean_name, rows.columns):
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return rows.toDF(*names)


def unpivot(
    rows: DataFrame, ids: Sequence[str], name: str = "name", value: str = "value"
) -> DataFrame:
    """All columns but ids to (name, value) rows."""
    return rows.unpivot(list(ids), None, name, value)


def with_region_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Inner join on region, NULL matching NULL: regions without a name drop out, regions with
    several names repeat their rows."""
    other = names.withColumnRenamed("region", "named_region")
    same = F.col("region").eqNullSafe(F.col("named_region"))
    return rows.join(other, same, "inner").drop("named_region")


def max_date(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("date").alias("date"))


def at_last_date(rows: DataFrame) -> DataFrame:
    """Rows at the latest date."""
    last = F.broadcast(max_date(rows).withColumnRenamed("date", "last_date"))  # one row
    return rows.join(last, F.col("date") == F.col("last_date")).drop("last_date")


def last_row(rows: DataFrame, order: Sequence[str] = ("date",)) -> DataFrame:
    return rows.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(1)


def transpose_row(row: DataFrame) -> DataFrame:
    """One row to (name, value) rows, values as text."""
    as_text: list[Column] = [F.col(f"`{c}`").cast("string").alias(c) for c in row.columns]
    return row.select(F.lit(1).alias("row of the table"), *as_text).unpivot(
        ["row of the table"], None, "name", "value"
    ).select("name", "value")


def sorted_output(rows: DataFrame, *columns: str) -> DataFrame:
    """Ascending, missing last; for files and screens, as no operator needs sorted input."""
    return rows.orderBy(*[F.asc_nulls_last(c) for c in columns])
