"""Small driver-side lists as tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, rows: Sequence[dict], schema: pa.Schema) -> DataFrame:
    """A literal table whose size the planner knows, so its broadcast needs no hint."""
    return spark.createDataFrame(pa.Table.from_pylist(list(rows), schema=schema))
