"""Region dimension."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.sources.local import local_table

# Price-area name, display name, region code.
REGIONS = [
    ("oslo", "Sørøst-Norge (NO1)", "no1"),
    ("kristiansand", "Sørvest-Norge (NO2)", "no2"),
    ("bergen", "Vest-Norge (NO5)", "no5"),
    ("trondheim", "Midt-Norge (NO3)", "no3"),
    ("tromso", "Nord-Norge (NO4)", "no4"),
]
_COLUMNS = ("name", "display_name", "region")


def region_dimension(spark: SparkSession) -> DataFrame:
    rows = [dict(zip(_COLUMNS, row)) for row in REGIONS]
    return local_table(spark, rows, pa.schema([(c, pa.string()) for c in _COLUMNS]))


def join_regions(prices: DataFrame, regions: DataFrame) -> DataFrame:
    """Left join on the area name; unknown names keep a NULL region."""
    return prices.join(regions, "name", "left")


def distinct_regions(prices: DataFrame) -> DataFrame:
    return prices.select("region", F.col("display_name").alias("region_name")).distinct()
