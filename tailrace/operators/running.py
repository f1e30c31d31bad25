"""Running totals in two levels: inside a bucket of the order column, plus what came before.

A window over a whole series puts the series into one task. Here the wide window only sees
one bucket (a month) of a series; the long one sees one total per bucket. A running total is
NULL from the first NULL of its series on.

guards maps each column to the one that counts its gaps: itself, or another column that is
NULL on the same rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys, NULL matching NULL. Keys come from the left side."""
    other = right.withColumnsRenamed({k: f"right__{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"right__{k}")) for k in keys])
    return left.join(other, same, "inner").drop(*[f"right__{k}" for k in keys])


def bucket_totals(columns: Sequence[str], guards: Mapping[str, str]) -> list[Column]:
    """Aggregates of one bucket: total per column, missing rows per guard column."""
    totals = [f"coalesce(sum({c}), 0D) AS total__{c}" for c in columns]
    missing = [f"count(*) - count({g}) AS missing__{g}" for g in _distinct(guards, columns)]
    return [F.expr(text) for text in totals + missing]


def before_bucket(totals: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Replace totals of a bucket by totals of all earlier buckets of the same series."""
    over = _over(keys, [bucket], "1 PRECEDING")
    carried = {
        c: F.expr(f"coalesce(sum({c}) OVER {over}, {'0D' if c.startswith('total__') else '0L'})")
        for c in totals.columns
        if c.startswith(("total__", "missing__"))
    }
    return totals.withColumns(carried)


def add_running(
    rows: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    columns: Sequence[str],
    guards: Mapping[str, str],
    prefix: str = "cum__",
) -> DataFrame:
    """Running totals of rows that carry the totals of earlier buckets."""
    over = _over([*keys, bucket], order, "CURRENT ROW")
    used = _distinct(guards, columns)
    inside = [f"sum({c}) OVER {over} AS in__{c}" for c in columns]
    gaps = [f"count(*) OVER {over} - count({g}) OVER {over} AS gap__{g}" for g in used]
    totals = [
        f"CASE WHEN missing__{guards[c]} + gap__{guards[c]} = 0"
        f" THEN total__{c} + in__{c} END AS {prefix}{c}"
        for c in columns
    ]
    helpers = {*[f"total__{c}" for c in columns], *[f"missing__{g}" for g in used]}
    kept = [c for c in rows.columns if c not in helpers]
    return rows.selectExpr("*", *inside, *gaps).selectExpr(*kept, *totals)


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    bucket: str,
    columns: Sequence[str],
    prefix: str = "cum__",
) -> DataFrame:
    """Running total of columns per keys in the given order. Rows are read twice, so they
    should be a table or cheap to compute."""
    guards = {c: c for c in columns}
    totals = rows.groupBy(*keys, bucket).agg(*bucket_totals(columns, guards))
    earlier = before_bucket(totals, keys, bucket)
    joined = join_null_safe(rows, earlier, [*keys, bucket])
    return add_running(joined, keys, bucket, [order], columns, guards, prefix)


def _distinct(guards: Mapping[str, str], columns: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(guards[c] for c in columns))


def _over(keys: Sequence[str], order: Sequence[str], end: str) -> str:
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    sort = ", ".join(f"{c} ASC NULLS LAST" for c in order)
    return f"({by}ORDER BY {sort} ROWS BETWEEN UNBOUNDED PRECEDING AND {end})"
