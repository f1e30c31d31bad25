"""CSV and JSON results with dotted column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailrace import schemas
from tailrace.functions import file_label
from tailrace.operators.reshape import max_date
from tailrace.plans.tables import move, remove


def dotted(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[schemas.DOTTED.get(c, c) for c in rows.columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """Header, NA for missing values, TRUE/FALSE for logicals."""
    logical = {
        f.name: F.upper(F.col(f.name).cast("string"))
        for f in rows.schema
        if isinstance(f.dataType, T.BooleanType)
    }
    (
        dotted(rows.withColumns(logical) if logical else rows)
        .write.mode("overwrite")
        .option("header", True)
        .option("nullValue", "NA")
        .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        .csv(path)
    )


def write_json(rows: DataFrame, path: str, digits: int | None = None) -> None:
    """One object per line, missing values left out, numbers in full precision or rounded."""
    if digits is not None:
        numbers = [f.name for f in rows.schema if isinstance(f.dataType, T.DoubleType)]
        rows = rows.withColumns({c: F.round(F.col(c), digits) for c in numbers})
    dotted(rows).write.mode("overwrite").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
    ).json(path)


def last_label(rows: DataFrame) -> str | None:
    """Latest date as a file label."""
    return max_date(rows).select(file_label(F.col("date"))).first()[0]


def write_results(national: DataFrame, minimal: DataFrame, folder: str, prefix: str = "") -> None:
    """All result files, their names after prefix. Both inputs are read several times, so they
    should be tables. Files are written aside and take their names when all are complete, so a job that
    fails leaves the results of the last one."""
    spark, aside = national.sparkSession, f"{folder}/_written-{uuid.uuid4().hex}"
    files = {
        f"{prefix}no-{last_label(national)}.csv": (write_csv, national),
        f"{prefix}no-latest.csv": (write_csv, national),
        f"{prefix}minimal-latest.csv": (write_csv, minimal),
        f"{prefix}minimal-latest.json": (write_json, minimal),
    }
    try:
        for name, (write, rows) in files.items():
            write(rows, f"{aside}/{name}")
        for name in files:
            move(spark, f"{aside}/{name}", f"{folder}/{name}")
    finally:
        remove(spark, aside)
