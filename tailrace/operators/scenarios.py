"""Scenario grid."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, fields
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.operators.revenue import with_coefficients
from tailrace.sources.local import local_table


@dataclass(frozen=True)
class Scenario:
    """One set of assumptions. The first four choose rows, the others only scale them."""

    # Defaults of the assumptions.
    freq: str = "daily"
    start_date: str = "2022-01-01"
    end_date: str | None = None  # None: the day after the run
    na_rm: bool = False
    param_price_baseline: float = 0.35
    param_skatt_grunnrente: float = 0.37
    param_skatt_selskap: float = 0.22
    param_prop_spot_eksponert: float = 0.70
    param_prop_hushold: float = 0.34
    param_prop_inntekt_faktisk: float = 0.9
    param_prop_statkraft: float = 0.42
    param_prop_kommfylk: float = 0.54
    param_prop_private: float = 0.04
    param_skatteposisjon_kr: float = 0.1
    group: str = "1"

    @property
    def variant(self) -> tuple:
        return self.freq, self.start_date, self.end_date, self.na_rm


# The grid of the published run.
PUBLISHED_GRID = {
    "freq": ["hourly"],
    "start_date": ["2022-01-01"],
    "param_price_baseline": [0.25, 0.35, 0.4],
    "param_prop_spot_eksponert": [0.5, 0.7],
    "na_rm": [True],
}

# Scenarios of a variant that share a join key, so that a large grid spreads over tasks.
SLICE = 1_000


def check_groups(scenarios: Sequence[Scenario]) -> None:
    """Results tell scenarios apart by their group alone."""
    repeated = [g for g, n in Counter(s.group for s in scenarios).items() if n > 1]
    if repeated:
        raise ValueError(f"several scenarios have group {', '.join(map(repr, repeated[:5]))}")


def expand_grid(**values: Sequence) -> list[Scenario]:
    """All combinations, first argument slowest; group numbers them from 1, as text."""
    names = list(values)
    return [
        Scenario(**dict(zip(names, combination)), group=str(i))
        for i, combination in enumerate(product(*values.values()), start=1)
    ]


def published_grid(**changes: Sequence) -> list[Scenario]:
    return expand_grid(**{**PUBLISHED_GRID, **changes})


def variants(scenarios: Sequence[Scenario]) -> list[tuple]:
    """Distinct row choices of the scenarios, in first-seen order."""
    return list(dict.fromkeys(s.variant for s in scenarios))


def _arrow(annotation: str) -> pa.DataType:
    return {"float": pa.float64(), "bool": pa.bool_()}.get(annotation, pa.string())


def scenario_table(
    spark: SparkSession, scenarios: Sequence[Scenario], numbers: Mapping[tuple, int]
) -> DataFrame:
    """The grid as a literal table with its variant numbers, slices and coefficients."""
    seen = Counter()
    rows = []
    for s in scenarios:
        number = numbers[s.variant]
        rows.append({**asdict(s), "variant": number, "slice": seen[number] // SLICE})
        seen[number] += 1
    keys = [("variant", pa.int32()), ("slice", pa.int32())]
    schema = pa.schema([(f.name, _arrow(f.type)) for f in fields(Scenario)] + keys)
    return with_coefficients(local_table(spark, rows, schema)).drop("end_date")


def expand_scenarios(
    rows: DataFrame,
    spark: SparkSession,
    scenarios: Sequence[Scenario],
    project: Sequence[str],
) -> DataFrame:
    """Every row once per scenario of its variant.

    One equi-join with the grid on (variant, slice): a row has each slice of its variant, one for a
    small grid. The planner broadcasts the grid or not by its size; the plan is the same for any grid.
    """
    numbers = {v: i for i, v in enumerate(variants(scenarios))}
    sizes = Counter(numbers[s.variant] for s in scenarios)
    last = F.array(*[F.lit((sizes[i] - 1) // SLICE) for i in range(len(numbers))])
    slices = F.sequence(F.lit(0), F.element_at(last, F.col("variant") + 1))
    keyed = rows.withColumn("slice", F.explode(slices))
    grid = scenario_table(spark, scenarios, numbers)
    return keyed.join(grid, ["variant", "slice"]).selectExpr(*project)
