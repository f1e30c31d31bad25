"""Calendar rules. Hour grain is clock time without a zone (timestamp_ntz)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_hours(hours: Column) -> tuple[Column, Column]:
    """'00 - 01' -> ('00', '01'). Any run of non-alphanumerics separates; missing piece -> NULL."""
    parts = F.split(hours, r"[^\p{Alnum}]+")
    return F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))


def hour_timestamp(date: Column, hour: Column) -> Column:
    """Date text and hour text -> clock time; a missing or malformed part gives NULL."""
    return F.concat(date, F.lit(" "), hour, F.lit(":00:00")).try_cast("timestamp_ntz")


def stat_month(code: Column) -> Column:
    """'2021M03' -> 2021-03-01."""
    return F.try_to_date(code, "yyyy'M'MM")


def month_start(date: Column) -> Column:
    return F.trunc(date.cast("date"), "month")


def year_month(date: Column) -> Column:
    return F.substring(date.cast("date").cast("string"), 1, 7)


def week_start(date: Column) -> Column:
    """Monday of the week, as a date."""
    day = date.cast("date")
    return F.date_sub(day, F.weekday(day))


def file_label(date: Column) -> Column:
    """'2022-01-02-130000', the clock time whatever the session's zone."""
    return F.translate(date.cast("timestamp_ntz").cast("string"), " :", "-")
