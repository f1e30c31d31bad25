"""Choice of the three feeds by frequency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tailrace import schemas
from tailrace.sources import documents, flat
from tailrace.sources.regions import region_dimension


@dataclass(frozen=True)
class Feeds:
    """Canonical production, consumption and price rows of one frequency."""

    production: DataFrame
    consumption: DataFrame
    prices: DataFrame


def load_feeds(
    spark: SparkSession,
    freq: str,
    paths: Mapping[str, str | Sequence[str]],
    fmt: str = "json",
    multi_line: bool = True,
    quarantine: documents.Quarantine | None = None,
) -> Feeds:
    """Read the feeds landed at paths['production'], ['consumption'] and ['prices']; a list names files, an
    empty one a feed without rows. A quarantine puts broken documents aside, which else stop the read.

    Flat formats (csv, parquet) are daily, as the documented flat shape is.
    """
    if freq not in ("daily", "hourly"):
        raise ValueError(f"freq = {freq} is not supported")
    if fmt == "json":

        def docs(feed, schema):
            if quarantine:
                return quarantine.read(spark, feed, paths[feed], schema, multi_line)
            return documents.read_documents(spark, paths[feed], schema, multi_line)

        if freq == "daily":
            return Feeds(
                documents.daily_power(docs("production", schemas.DAILY_ITEMS_JSON)),
                documents.daily_power(docs("consumption", schemas.DAILY_ITEMS_JSON)),
                documents.daily_prices(docs("prices", schemas.DAILY_PRICES_JSON)),
            )
        return Feeds(
            documents.hourly_power(docs("production", schemas.HOURLY_ITEMS_JSON)),
            documents.hourly_power(docs("consumption", schemas.HOURLY_ITEMS_JSON)),
            documents.hourly_prices(
                docs("prices", schemas.HOURLY_PRICES_JSON), region_dimension(spark)
            ),
        )
    if freq == "hourly":
        raise ValueError(f"{fmt} feeds are daily only")

    def rows(feed, schema):
        return flat.read_flat(spark, paths[feed], schema, fmt)

    return Feeds(
        flat.power_rows(rows("production", schemas.POWER_CSV)),
        flat.power_rows(rows("consumption", schemas.POWER_CSV)),
        flat.price_rows(rows("prices", schemas.PRICES_CSV)),
    )
