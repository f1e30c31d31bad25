"""Statistics table: code labels and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace import schemas
from tailrace.sources.flat import read_flat

@dataclass(frozen=True)
class Statistics:
    """Coded facts and, by variable, the list of its codes and labels."""

    fact: DataFrame
    metadata: Mapping[str, DataFrame]

    def labelled(self, codes: Mapping[str, Sequence[str] | str | bool] | None = None) -> DataFrame:
        return label_codes(self.fact, self.metadata, codes)


def read_statistics(
    spark: SparkSession,
    fact: str,
    labels: Mapping[str, str] | None = None,
    fmt: str = "parquet",
) -> Statistics:
    """The statistics table landed at `fact` (ContentsCode, Produk2, Tid, value) and the code lists landed
    at labels[variable] (values, valueTexts), as parquet or CSV with a header."""
    lists = {v: read_flat(spark, path, schemas.STAT_LABELS, fmt) for v, path in (labels or {}).items()}
    return Statistics(read_flat(spark, fact, schemas.STAT_FACT, fmt), lists)


def select_codes(fact: DataFrame, codes: Mapping[str, Sequence[str] | str | bool]) -> DataFrame:
    """Keep the requested codes of each variable; True keeps all of them."""
    for variable, wanted in codes.items():
        if wanted is not True:
            wanted = [wanted] if isinstance(wanted, str) else list(wanted)
            fact = fact.filter(F.col(variable).isin(wanted))
    return fact


def label_codes(
    fact: DataFrame,
    metadata: Mapping[str, DataFrame],
    codes: Mapping[str, Sequence[str] | str | bool] | None = None,
) -> DataFrame:
    """Attach '<variable>.Label' after each coded variable.

    Inner joins: a code without a label drops its rows. Label lists carry no broadcast hint;
    the planner picks the strategy from their size.
    """
    labelled = select_codes(fact, codes or {})
    for variable, labels in metadata.items():
        if variable not in fact.columns:
            continue
        label = f"{variable}.Label"
        named = labels.select(F.col("values").alias(variable), F.col("valueTexts").alias(label))
        at = labelled.columns.index(variable) + 1
        order = [*labelled.columns[:at], label, *labelled.columns[at:]]
        labelled = labelled.join(named, variable, "inner").select([f"`{c}`" for c in order])
    return labelled.withColumnsRenamed(
        {"ContentsCode": "Variable", "ContentsCode.Label": "Variable.Label", "value": "Value"}
    )


def metadata_long(
    metadata: Mapping[str, DataFrame], simplify: bool = False
) -> DataFrame | Mapping[str, DataFrame]:
    """All code lists as (key, code, desc); simplify=False hands back the tables."""
    if not simplify:
        return metadata
    parts = [
        labels.select(
            F.lit(key).alias("key"),
            F.col("values").alias("code"),
            F.col("valueTexts").alias("desc"),
        )
        for key, labels in metadata.items()
    ]
    return reduce(DataFrame.unionByName, parts)
