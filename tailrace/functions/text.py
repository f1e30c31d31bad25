"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailrace.functions.missing import nan_to_null

# Fixed value: pattern of a price-area code inside a display name.
AREA_PATTERN = r"NO\d+"


def area_code(display_name: Column) -> Column:
    """'Vest-Norge (NO5)' -> 'no5'; no code -> NULL."""
    return F.lower(F.regexp_substr(display_name, F.lit(AREA_PATTERN)))


def number(c: Column) -> Column:
    """Lenient text to double: anything that is no number becomes NULL."""
    return nan_to_null(c.try_cast("double"))


def text_of(c: Column) -> Column:
    """The text of a JSON value that is text."""
    return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))


def number_of(c: Column) -> Column:
    """A JSON number as it is, text by the rule of number(); anything else becomes NULL."""
    numeric = F.schema_of_variant(c).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric, nan_to_null(F.try_variant_get(c, "$", "double"))).otherwise(number(text_of(c)))
