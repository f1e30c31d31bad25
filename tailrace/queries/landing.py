"""Warehouse feeds landed as documents and files, so that queries read them as a run would.

A document holds one day or one month of a few price areas, as landed files do: its size is
bounded by the calendar and the areas, whatever the size of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions import month_start
from tailrace.plans.tables import new_path
from tailrace.sources.feeds import Feeds


def landed_documents(documents: DataFrame, name: str, path: str | None = None) -> str:
    """Write one JSON document per line; returns the path."""
    path = path or new_path(documents.sparkSession, name)
    text = F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"})
    documents.select(text).write.text(path)
    return path


def landed_csv(rows: DataFrame, name: str) -> str:
    path = new_path(rows.sparkSession, name)
    rows.write.option("header", True).csv(path)
    return path


def land_daily(feeds: Feeds, folder: str, part: str) -> dict[str, str]:
    """Land daily feeds as documents in a folder by feed, this part in a folder of its own; returns the feeds'
    folders."""
    made = {
        "production": daily_power_documents(feeds.production),
        "consumption": daily_power_documents(feeds.consumption),
        "prices": daily_price_documents(feeds.prices),
    }
    for feed, documents in made.items():
        landed_documents(documents, feed, f"{folder}/{feed}/{part}")
    return {feed: f"{folder}/{feed}" for feed in made}


def daily_power_documents(power: DataFrame) -> DataFrame:
    """One document per day."""
    item = F.struct(F.col("date").cast("string").alias("date"), "zone", F.col("mwh").alias("MWh"))
    return power.groupBy("date").agg(F.collect_list(item).alias("items")).select("items")


def hourly_power_documents(items: DataFrame) -> DataFrame:
    item = F.struct("date", "hours", "zone", "MWh")
    return items.groupBy("date").agg(F.collect_list(item).alias("items")).select("items")


def daily_price_documents(prices: DataFrame) -> DataFrame:
    """One document per month and date axis; areas with the same axis share a document."""
    month = month_start(F.col("date")).alias("month")
    points = F.array_sort(F.collect_list(F.struct("date", "value")))
    area = (
        prices.groupBy(month, "name", "display_name")
        .agg(points.alias("points"))
        .select(
            "month",
            F.transform("points", lambda p: p["date"].cast("string")).alias("dates"),
            F.struct(
                "name",
                F.col("display_name").alias("displayName"),
                F.col("points.value").alias("data"),
            ).alias("area"),
        )
    )
    shared = area.groupBy("month", "dates").agg(F.collect_list("area").alias("prices"))
    return shared.select(F.struct("dates", "prices").alias("historic"))


def hourly_price_documents(items: DataFrame) -> DataFrame:
    """One matrix per day: hours down, areas across. Every seventh hour has text that is no
    number in some cells."""
    bad = (F.substring("hours", 1, 2).cast("int") % 7 == 0) & (F.col("name") == "oslo")
    cell = F.struct("name", F.when(bad, F.lit("12,5")).otherwise(F.col("value")).alias("value"))
    cells = F.map_from_entries(F.collect_list(cell)).alias("cells")
    by_hour = items.groupBy("date", "hours").agg(cells)
    by_day = by_hour.groupBy("date").agg(
        F.collect_list(F.struct("hours", "cells")).alias("hours"),
    )
    seen = F.flatten(F.transform("hours", lambda h: F.map_keys(h["cells"])))
    named = by_day.withColumn("names", F.array_sort(F.array_distinct(seen)))
    rows = F.transform(
        "hours",
        lambda h: F.concat(
            F.array(F.col("date"), h["hours"]),
            F.transform("names", lambda n: F.try_element_at(h["cells"], n)),
        ),
    )
    return named.select(
        F.concat(F.array(F.lit("date"), F.lit("hours")), F.col("names")).alias("columns"),
        rows.alias("rows"),
    )


def with_numbers(documents: DataFrame) -> DataFrame:
    """Matrix documents whose even hours have prices as JSON numbers; all else stays text."""

    def typed(cell: Column, at: Column, row: Column) -> Column:
        even = F.substring(row[1], 1, 2).cast("int") % 2 == 0
        bare = even & (at > 1) & cell.try_cast("double").isNotNull()
        return F.parse_json(F.when(bare, cell).otherwise(F.concat(F.lit('"'), cell, F.lit('"'))))

    rows = F.transform("rows", lambda row: F.transform(row, lambda cell, at: typed(cell, at, row)))
    return documents.withColumn("rows", rows)
