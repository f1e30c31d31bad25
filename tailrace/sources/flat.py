"""Flat files (CSV with a header, parquet) to canonical rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailrace.functions import nan_to_null


def read_flat(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, fmt: str = "csv"
) -> DataFrame:
    """Rows of the schema's columns; an empty list of files has none. A CSV file whose header names other columns, or the same in
    another order, stops the read, and so does a value of another type."""
    if not path:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, enforceSchema=False, mode="FAILFAST")
    return reader.load(path)


def power_rows(rows: DataFrame) -> DataFrame:
    return rows.select("date", "zone", nan_to_null(F.col("MWh")).alias("mwh"))


def price_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "date",
        "name",
        F.col("displayName").alias("display_name"),
        "region",
        nan_to_null(F.col("value")).alias("value"),
    )
