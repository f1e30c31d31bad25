"""Landed JSON documents to canonical rows.

Canonical power rows: date, zone, mwh (hourly adds hour_start, hour_end).
Canonical price rows: date, name, display_name, region, value (hourly adds the hour columns).
A parser takes one document per row, so files spread over tasks; each document explodes on
its own and no document meets another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailrace.functions import area_code, hour_timestamp, nan_to_null, number, number_of, split_hours, text_of
from tailrace.sources.regions import join_regions


def read_documents(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType, multi_line: bool = True
) -> DataFrame:
    """One document per file (multi_line) or one per line. Text that is no JSON, or a value of
    another type, stops the read. An empty list of files has no documents."""
    if not path:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", multi_line).json(path)


class Quarantine:
    """Puts broken documents aside instead of stopping: documents that are no JSON, hold a value of another
    type, or lack their array. More than `at_most` of them in a feed stop the read all the same.

    write(rows, name) stores rows once and returns the table (as Tables.write does), so that every document is
    parsed once. `broken` has feed, path, reason and document of what was put aside.
    """

    TEXT, PATH, REASON = "_document", "_path", "_reason"

    def __init__(self, write: Callable[[DataFrame, str], DataFrame], at_most: int):
        self.write, self.at_most = write, at_most
        self.parts: list[DataFrame] = []

    def read(
        self, spark: SparkSession, feed: str, path: str | Sequence[str], schema: T.StructType, multi_line: bool = True
    ) -> DataFrame:
        """The documents of a feed that can be used."""
        if not path:
            return spark.createDataFrame([], schema)
        text = T.StructType([*schema.fields, T.StructField(self.TEXT, T.StringType())])
        reader = spark.read.schema(text).options(mode="PERMISSIVE", columnNameOfCorruptRecord=self.TEXT)
        parsed = reader.option("multiLine", multi_line).json(path).withColumn(self.PATH, F.col("_metadata.file_path"))
        array = NEEDED[schema.fieldNames()[0]]
        lacks = F.when(reduce(Column.__or__, [F.col(c).isNull() for c in array]), F.lit(f"no {array[0]}"))
        reason = F.when(F.col(self.TEXT).isNotNull(), F.lit("unreadable")).otherwise(lacks)
        held = self.write(parsed.withColumn(self.REASON, reason), f"documents-{feed}")
        broken = held.where(F.col(self.REASON).isNotNull())
        number = broken.count()
        if number > self.at_most:
            example = broken.select(self.PATH).first()[0]
            raise ValueError(f"{number} documents of {feed} are broken, as one of {example}")
        columns = [F.col(c).alias(c[1:]) for c in (self.PATH, self.REASON, self.TEXT)]
        self.parts.append(broken.select(F.lit(feed).alias("feed"), *columns))
        return held.where(F.col(self.REASON).isNull()).select(*schema.fieldNames())

    @property
    def broken(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


# The arrays that a document must have, by its first field.
NEEDED = {"historic": ["historic.dates", "historic.prices"], "columns": ["columns", "rows"], "items": ["items"]}


def required(name: str) -> Column:
    """An array that every document has; a document without it stops the query, while explode()
    would drop it."""
    missing = F.raise_error(F.lit(f"a document has no {name}"))
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(missing)


def daily_prices(documents: DataFrame) -> DataFrame:
    """Shared date axis and one value list per area, exploded in parallel.

    arrays_zip would pad the shorter list with NULL, so unequal lengths raise.
    """
    area = documents.select(
        required("historic.dates").alias("dates"),
        F.explode(required("historic.prices")).alias("area"),
    )
    problem = F.concat(F.lit("dates and prices differ in length: "), F.col("area.name"))
    pairs = F.when(
        F.size("dates") == F.size("area.data"),
        F.arrays_zip(F.col("dates"), F.col("area.data").alias("data")),
    ).otherwise(F.raise_error(problem))
    return area.select("area.name", "area.displayName", F.explode(pairs).alias("pair")).select(
        F.try_to_date(F.col("pair.dates")).alias("date"),
        "name",
        F.col("displayName").alias("display_name"),
        area_code(F.col("displayName")).alias("region"),
        nan_to_null(F.col("pair.data")).alias("value"),
    )


def hourly_price_cells(documents: DataFrame) -> DataFrame:
    """Matrix with named columns to one row per hour and area, values still as in the document."""
    row = documents.select(
        required("columns").alias("columns"), F.explode(required("rows")).alias("row")
    ).select(
        F.map_from_arrays("columns", "row").alias("cells")
    )
    areas = F.map_filter("cells", lambda key, _: ~key.isin("date", "hours"))
    text = text_of if typed_cells(row) else (lambda c: c)
    return row.select(
        text(F.col("cells")["date"]).alias("date"),
        text(F.col("cells")["hours"]).alias("hours"),
        F.explode(areas).alias("name", "value"),
    )


def typed_cells(row: DataFrame) -> bool:
    """Whether cells are VARIANTs, which keep numbers apart from text."""
    return isinstance(row.schema["cells"].dataType.valueType, T.VariantType)


def cell_number(cells: DataFrame) -> Column:
    typed = isinstance(cells.schema["value"].dataType, T.VariantType)
    return (number_of if typed else number)(F.col("value"))


def hourly_prices(documents: DataFrame, regions: DataFrame) -> DataFrame:
    cells = _at_hour(hourly_price_cells(documents))
    cells = cells.withColumn("value", cell_number(cells))
    return join_regions(cells, regions).select(
        "date",
        "hour_start",
        "hour_end",
        "name",
        "display_name",
        "region",
        "value",
    )


def daily_power(documents: DataFrame) -> DataFrame:
    return documents.select(F.inline(required("items"))).select(
        F.try_to_date(F.col("date")).alias("date"), "zone", nan_to_null(F.col("MWh")).alias("mwh")
    )


def hourly_power(documents: DataFrame) -> DataFrame:
    items = documents.select(F.inline(required("items")))
    return _at_hour(items).select(
        "date", "hour_start", "hour_end", "zone", nan_to_null(F.col("MWh")).alias("mwh")
    )


def _at_hour(rows: DataFrame) -> DataFrame:
    """Replace the hours text by its two parts and move the date to the start hour."""
    start, end = split_hours(F.col("hours"))
    return rows.withColumns(
        {"hour_start": start, "hour_end": end, "date": hour_timestamp(F.col("date"), start)}
    ).drop("hours")
