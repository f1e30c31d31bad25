"""Energy balance: three long feeds to one row per (date, region)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.functions import is_missing
from tailrace.sources.feeds import Feeds

PRICE = "price"
VARIABLES = ["pro", "cnp", PRICE]

# Zone of the national total; MWh to kWh; price unit to currency per kWh.
TOTAL_ZONE = "NO"
KWH_PER_MWH = 1000
PRICE_DIVISOR = 100


def drop_total_zone(power: DataFrame) -> DataFrame:
    """Price areas only; a NULL zone goes too."""
    return power.filter(F.col("zone") != TOTAL_ZONE)


def balance_long(feeds: Feeds, names: bool = False) -> DataFrame:
    """(date, region, value, variable) of all feeds, units scaled; with names also the region_name of prices."""

    def name(text: Column) -> list[Column]:
        return [text.cast("string").alias("region_name")] if names else []

    def power(rows: DataFrame, variable: str) -> DataFrame:
        return drop_total_zone(rows).select(
            "date",
            F.lower("zone").alias("region"),
            (F.col("mwh") * KWH_PER_MWH).alias("value"),
            F.lit(variable).alias("variable"),
            *name(F.lit(None)),
        )

    prices = feeds.prices.select(
        "date",
        F.lower("region").alias("region"),
        (F.col("value") / PRICE_DIVISOR).alias("value"),
        F.lit(PRICE).alias("variable"),
        *name(F.col("display_name")),
    )
    return (
        power(feeds.production, "pro")
        .unionByName(power(feeds.consumption, "cnp"))
        .unionByName(prices)
    )


def balance_wide(long: DataFrame, on_duplicate: str = "raise", *also: str) -> DataFrame:
    """One row per (date, region) that any feed has, NULL where a feed lacks it; also names columns that
    depend on these two and stay.

    Conditional aggregates pivot in one exchange (pivot() would take two) and combine before
    it, so copies of one key cannot pile up in a task. A cell with several rows raises, or is
    averaged with on_duplicate="mean" (the repeated hour when clocks go back).
    """
    if on_duplicate not in ("raise", "mean"):
        raise ValueError(f"on_duplicate = {on_duplicate} is not supported")

    def cell(variable: str) -> Column:
        here = F.col("variable") == variable
        value = F.when(here, F.col("value"))
        if on_duplicate == "mean":
            return F.avg(value)
        where = F.concat_ws(" ", F.lit(variable), F.col("date").cast("string"), F.col("region"))
        return F.when(F.count(F.when(here, 1)) <= 1, F.max(value)).otherwise(
            F.raise_error(F.concat(F.lit("several values for "), where))
        )

    return long.groupBy(*also, "date", "region").agg(*[cell(v).alias(v) for v in VARIABLES])


def is_complete() -> Column:
    return reduce(Column.__and__, [~is_missing(F.col(v)) for v in VARIABLES])


def complete_rows(wide: DataFrame) -> DataFrame:
    """Rows where no variable is missing."""
    return wide.filter(is_complete())


def in_date_range(rows: DataFrame, start: Column, end: Column, date: str = "date") -> DataFrame:
    """start <= date <= end, both dates. At hour grain a date is its 00:00, so of the
    last day only that hour stays."""
    return rows.filter((F.col(date) >= start) & (F.col(date) <= end))
