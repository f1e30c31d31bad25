"""Missing-value rules: NULL is the only missing marker inside the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """NaN becomes NULL. Applied once, where data enters the engine."""
    return F.when(~F.isnan(c), c)


def is_missing(c: Column) -> Column:
    return c.isNull() | F.isnan(c)


def sum0(c: Column) -> Column:
    """Sum that skips NULL; a group without any value gives 0, not NULL."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def pmax(c: Column, floor: float) -> Column:
    """Parallel maximum. NULL stays NULL, while greatest() would return the floor."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(floor))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with NULL for a zero denominator."""
    return F.try_divide(numerator, denominator)
