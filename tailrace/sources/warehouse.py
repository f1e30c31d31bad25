"""Order and event tables as power feeds.

Ordered quantity stands for energy, price per unit for the spot price, a sales region for a
price area. Dates shift so that the data run from 2021 over all tariff changes. Sums are exact:
quantities are whole numbers and money is summed as decimal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.functions import hour_timestamp, month_start
from tailrace.operators.hydro_share import CONTENTS, HYDRO, TOTAL
from tailrace.sources.feeds import Feeds
from tailrace.sources.regions import join_regions, region_dimension

# The columns that are used, so that no job has to look them up.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int",
    "supplier": "s_suppkey long, s_nationkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double,"
    " l_returnflag string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
}

DATE_SHIFT_DAYS = 9497  # 1995-01-01 becomes 2021-01-01


class Warehouse:
    """Feeds derived from the tables in one folder.

    No join carries a broadcast hint: suppliers, customers and orders grow with the data, so
    the planner decides by their size and adaptive execution splits skewed partitions.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def zones(self) -> DataFrame:
        """nation key -> zone of its sales region."""
        return self.table("nation").select("n_nationkey", _zone("n_regionkey").alias("zone"))

    def shipped(self) -> DataFrame:
        """Quantity and money per day and zone, with the region's name. Lines collapse to one row per
        supplier and day before they meet the supplier, so a hot supplier weighs no more than others."""
        sold = self.table("lineitem").groupBy("l_suppkey", shifted(F.col("l_shipdate")).alias("date"))
        days = (
            sold.agg(
                F.sum("l_quantity").alias("mwh"),
                F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("money"),
            )
            .join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.zones(), F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("date", "zone")
            .agg(F.sum("mwh").alias("mwh"), F.sum("money").alias("money"))
        )
        names = self.table("region").select(
            _zone("r_regionkey").alias("zone"), F.col("r_name").alias("name")
        )
        return days.join(names, "zone")

    def production(self, shipped: DataFrame | None = None) -> DataFrame:
        shipped = self.shipped() if shipped is None else shipped
        return _with_total_zone(shipped.select("date", "zone", "mwh"))

    def consumption(self) -> DataFrame:
        """Quantities collapse to one row per order before they meet the order, on the same
        partitioning, and to one per customer and day before they meet the customer, so neither an
        order with very many lines nor a hot customer weighs more than any other."""
        lines = self.table("lineitem")
        quantity = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("mwh"))
        sold = (
            quantity.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", shifted(F.col("o_orderdate")).alias("date"))
            .agg(F.sum("mwh").alias("mwh"))
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .join(self.zones(), F.col("c_nationkey") == F.col("n_nationkey"))
        )
        return _with_total_zone(sold.groupBy("date", "zone").agg(F.sum("mwh").alias("mwh")))

    def prices(self, shipped: DataFrame | None = None) -> DataFrame:
        shipped = self.shipped() if shipped is None else shipped
        return shipped.select(
            "date",
            "name",
            F.concat("name", F.lit(" ("), "zone", F.lit(")")).alias("display_name"),
            F.lower("zone").alias("region"),
            (F.col("money").cast("double") / F.col("mwh") / 10).alias("value"),
        )

    def daily(self) -> Feeds:
        """All daily feeds. Two of them come from the same lines; in one plan they share that exchange."""
        shipped = self.shipped()
        return Feeds(self.production(shipped), self.consumption(), self.prices(shipped))

    def statistics(self) -> DataFrame:
        """Monthly quantity of all items and of finished items, coded."""
        hydro = F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_quantity"))
        months = (
            self.table("lineitem")
            .groupBy(month_start(shifted(F.col("l_shipdate"))).alias("month"))
            .agg(F.sum("l_quantity").alias(TOTAL), F.sum(hydro).alias("hydro"))
        )
        coded = F.inline(
            F.array(
                F.struct(F.lit(TOTAL).alias("Produk2"), F.col(TOTAL).alias("value")),
                F.struct(F.lit(HYDRO).alias("Produk2"), F.col("hydro").alias("value")),
            )
        )
        return months.select(F.date_format("month", "yyyy'M'MM").alias("Tid"), coded).select(
            F.lit(CONTENTS).alias("ContentsCode"), "Produk2", "Tid", "value"
        )

    def hourly_cells(self) -> DataFrame:
        """Event value per hour and event type, with the hour as text."""
        start = F.hour("ts")
        return (
            self.table("events")
            .groupBy(F.to_date("ts").alias("day"), start.alias("hour"), "event_type")
            .agg(
                _money(F.col("value")).alias("all_value"),
                _money(F.when(F.col("user_id") % 2 == 0, F.col("value"))).alias("even_value"),
                F.count(F.lit(1)).alias("n"),
            )
            .withColumn(
                "hours",
                F.concat(_two_digits(F.col("hour")), F.lit(" - "), _two_digits(F.col("hour") + 1)),
            )
        )

    def hourly_items(self, value: str) -> DataFrame:
        """date, hours, zone, MWh as text and numbers; a cell without value has no item."""
        cells = self.hourly_cells().filter(F.col(value).isNotNull())
        return cells.select(
            F.date_format("day", "yyyy-MM-dd").alias("date"),
            "hours",
            _event_zone().alias("zone"),
            F.col(value).alias("MWh"),
        )

    def hourly(self) -> Feeds:
        """Hour-grain feeds without a detour over documents; in one plan they share one exchange."""
        cells = self.hourly_cells()

        def power(value: str) -> DataFrame:
            return cells.filter(F.col(value).isNotNull()).select(
                _clock().alias("date"), _event_zone().alias("zone"), F.col(value).alias("mwh")
            )

        named = cells.select(
            _clock().alias("date"), _area_name().alias("name"), _price().alias("value")
        )
        prices = join_regions(named, region_dimension(self.spark))
        return Feeds(power("all_value"), power("even_value"), prices)

    def hourly_price_items(self) -> DataFrame:
        """date, hours, name, value as text."""
        return self.hourly_cells().select(
            F.date_format("day", "yyyy-MM-dd").alias("date"),
            "hours",
            _area_name().alias("name"),
            _price().cast("string").alias("value"),
        )


def shifted(date: Column) -> Column:
    return F.date_add(date.cast("date"), DATE_SHIFT_DAYS)


def _zone(region_key: str) -> Column:
    return F.concat(F.lit("NO"), F.col(region_key) + 1)


def _with_total_zone(power: DataFrame) -> DataFrame:
    total = power.groupBy("date").agg(F.sum("mwh").alias("mwh"))
    return power.unionByName(total.withColumn("zone", F.lit("NO")))


def _money(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def _two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _clock() -> Column:
    return hour_timestamp(F.date_format("day", "yyyy-MM-dd"), F.substring("hours", 1, 2))


def _price() -> Column:
    return F.col("all_value") / F.col("n") * 4


# Event types as price areas; 'signup' has a name outside the region dimension.
_AREAS = {
    "click": ("NO1", "oslo"),
    "error": ("NO2", "kristiansand"),
    "purchase": ("NO3", "trondheim"),
    "signup": ("NO4", "unmapped"),
    "view": ("NO5", "bergen"),
}


def _by_event(position: int) -> Column:
    value = F.lit(None).cast("string")
    for event_type, area in _AREAS.items():
        value = F.when(F.col("event_type") == event_type, F.lit(area[position])).otherwise(value)
    return value


def _event_zone() -> Column:
    return _by_event(0)


def _area_name() -> Column:
    return _by_event(1)
