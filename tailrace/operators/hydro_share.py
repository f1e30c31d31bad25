"""Hydropower share of production: monthly ratio, four-month ratio, as-of join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailrace.functions import month_start, nan_to_null, ratio, stat_month

# Statistics variable, product codes, rows in the trailing window.
CONTENTS = "Kraft"
TOTAL, HYDRO = "01", "01.01"
WINDOW_ROWS = 4

# Columns of a calendar month with the instants that cut it.
CUT = "cut_"


def monthly_share(fact: DataFrame) -> DataFrame:
    """Coded fact rows (ContentsCode, Produk2, Tid, value) to series, date, total, hydro, ratio.

    One row per month: two values for a month and product raise.
    """

    def product(code: str):
        here = F.col("Produk2") == code
        return F.when(
            F.count(F.when(here, 1)) <= 1, F.max(F.when(here, nan_to_null(F.col("value"))))
        ).otherwise(F.raise_error(F.concat(F.lit(f"several values of {code} for "), F.col("Tid"))))

    wanted = fact.filter((F.col("ContentsCode") == CONTENTS) & F.col("Produk2").isin(TOTAL, HYDRO))
    return (
        wanted.groupBy("ContentsCode", "Tid")
        .agg(product(TOTAL).alias("total"), product(HYDRO).alias("hydro"))
        .select(
            "ContentsCode",
            stat_month(F.col("Tid")).alias("date"),
            "total",
            "hydro",
            ratio(F.col("hydro"), F.col("total")).alias("hydro_ratio_month"),
        )
    )


def with_trailing_ratio(monthly: DataFrame) -> DataFrame:
    """Ratio of means over the current and three earlier rows; NULL unless all four are known.

    The window sees one row per month, twelve a year at any data size.
    """
    by_date = W.partitionBy("ContentsCode").orderBy(F.asc_nulls_last("date"))
    w = by_date.rowsBetween(1 - WINDOW_ROWS, 0)
    full = F.least(F.count(F.lit(1)).over(w), F.count("hydro").over(w), F.count("total").over(w))
    return monthly.withColumn(
        "hydro_ratio_ma4",
        F.when(full == WINDOW_ROWS, ratio(F.avg("hydro").over(w), F.avg("total").over(w))),
    )


def share_by_month(balance: DataFrame, share: DataFrame) -> DataFrame:
    """Share that holds in each month that the balance has: (month, on_first, later)."""
    return carried_share(first_days(balance), share)


def first_days(balance: DataFrame) -> DataFrame:
    """The months of the balance, and whether they have rows on their first day."""
    return balance.groupBy(month_start(F.col("date")).alias("month")).agg(
        F.max(F.dayofmonth("date") == 1).alias("has_first")
    )


def carried_share(months: DataFrame, share: DataFrame) -> DataFrame:
    """(month, on_first, later) from the months seen and the shares published.

    A month's figures are seen through the balance rows of its first day only; without such
    rows the month keeps what earlier months left. So the as-of search needs one row per
    month, and the facts are aggregated to months before anything is ordered: the one window
    without partitions orders calendar months, not facts.
    """
    seen = months.join(share, (F.col("month") == F.col("date")) & F.col("has_first"), "left")
    w = W.orderBy(F.asc_nulls_last("month")).rowsBetween(W.unboundedPreceding, 0)
    carried = F.last("hydro_ratio_ma4", ignorenulls=True).over(w)
    return seen.select(
        "month",
        F.coalesce("hydro_ratio_month", carried).alias("on_first"),
        carried.alias("later"),
    )


def with_cuts(months: DataFrame, cuts: Mapping[dt.date, Sequence[dt.datetime]]) -> DataFrame:
    """Attach the instants that cut each month, a column each, NULL beyond a month's last. They begin or end at
    midnight, so a month has 62 at most."""
    known = {_literal_key(month): F.array(*map(_instant, found)) for month, found in cuts.items()}
    if not known:
        return months
    pairs = [c for key, found in known.items() for c in (F.lit(key), found)]
    found = F.try_element_at(F.create_map(*pairs), _month_key(F.col("month")))
    most = max(map(len, cuts.values()))
    return months.withColumns({f"{CUT}{i}": F.get(found, F.lit(i)) for i in range(most)})


def with_month_share(balance: DataFrame, months: DataFrame) -> DataFrame:
    """Attach what is known of the row's month: the two shares, cuts. Whole-number keys make the lookup an array
    access; a NULL date finds the month without a date."""
    keyed = balance.withColumn("share_key", _month_key(F.col("date")))
    shares = months.withColumn("share_key", _month_key(F.col("month"))).drop("month")
    # Calendar months: at most 120,000 rows in the range of the date type.
    return keyed.join(F.broadcast(shares), "share_key", "left").drop("share_key")


def day_share() -> Column:
    """The month's own share on day 1, the carried one on all other days."""
    return F.when(F.dayofmonth("date") == 1, F.col("on_first")).otherwise(F.col("later"))


def with_hydro_share(balance: DataFrame, months: DataFrame) -> DataFrame:
    """Attach ssb_prop_vannkraft."""
    shared = with_month_share(balance, months)
    return shared.withColumn("ssb_prop_vannkraft", day_share()).drop("on_first", "later")


def _literal_key(month: dt.date) -> int:
    return (month - dt.date(1970, 1, 1)).days


def _instant(instant: dt.datetime) -> Column:
    return F.lit(instant.isoformat()).cast("timestamp_ntz")


def _month_key(date: Column) -> Column:
    return F.coalesce(F.unix_date(month_start(date)), F.lit(-(2**31)))
