"""Column builders for the null, text and calendar rules of the engine."""

from tailrace.functions.missing import is_missing, nan_to_null, pmax, ratio, sum0
from tailrace.functions.text import area_code, number, number_of, text_of
from tailrace.functions.times import (
    file_label,
    hour_timestamp,
    month_start,
    split_hours,
    stat_month,
    week_start,
    year_month,
)

__all__ = [
    "area_code",
    "file_label",
    "hour_timestamp",
    "is_missing",
    "month_start",
    "nan_to_null",
    "number",
    "number_of",
    "pmax",
    "ratio",
    "split_hours",
    "stat_month",
    "sum0",
    "text_of",
    "week_start",
    "year_month",
]
