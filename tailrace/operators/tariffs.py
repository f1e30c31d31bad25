"""Tariffs and support rates by date and region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tariff parameters. A schedule lists (valid from, value) by date; None means
# from the beginning, and a date before the first entry has no value.
VAT = 0.25
VAT_FREE_REGION = "no4"
SUPPORT_FLOOR = 0.70
SUPPORT_SHARE = [
    (None, 0.0),
    ("2021-12-01", 0.55),
    ("2022-01-01", 0.8),
    ("2022-09-01", 0.9),
]
LEVY_SHARE_GENERAL = 0.55
LEVY_SHARE_REDUCED = 0.16
LEVY_SHARE_EXEMPT = 0.28
LEVY_RATE_REDUCED_NORMAL = 0.00546
LEVY_RATE_GENERAL_NORMAL = 0.1669
LEVY_RATE_REDUCED = 0.00546
LEVY_RATE_GENERAL = [
    ("2021-01-01", 0.1669),
    ("2022-01-01", 0.0891),
    ("2022-04-01", 0.1541),
]


def scheduled(date: Column, schedule: Sequence[tuple[str | None, float]]) -> Column:
    """Value of the latest entry whose start is not after the date; NULL date gives NULL."""
    value = F.lit(None).cast("double")
    for start, rate in schedule:
        reached = date.isNotNull() if start is None else date >= F.lit(start).cast("date")
        value = F.when(reached, F.lit(rate)).otherwise(value)
    return value


def with_tariffs(rows: DataFrame) -> DataFrame:
    date, region = F.col("date"), F.col("region")
    return rows.withColumns(
        {
            "param_mva": F.when(region == VAT_FREE_REGION, F.lit(0.0)).otherwise(F.lit(VAT)),
            "param_stromstotte_floor": F.lit(SUPPORT_FLOOR),
            "param_stromstotte_prop": scheduled(date, SUPPORT_SHARE),
            "param_elavgift_prop_alminnelig": F.lit(LEVY_SHARE_GENERAL),
            "param_elavgift_prop_redusert": F.lit(LEVY_SHARE_REDUCED),
            "param_elavgift_prop_fritatt": F.lit(LEVY_SHARE_EXEMPT),
            "param_elavgift_sats_redusert_normal": F.lit(LEVY_RATE_REDUCED_NORMAL),
            "param_elavgift_sats_alminnelig_normal": F.lit(LEVY_RATE_GENERAL_NORMAL),
            "param_elavgift_sats_redusert": F.lit(LEVY_RATE_REDUCED),
            "param_elavgift_sats_alminnelig": scheduled(date, LEVY_RATE_GENERAL),
        }
    )
