"""The batch job: landed feeds in, result files out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from tailrace.operators.scenarios import Scenario, published_grid
from tailrace.plans.run import RevenueRun
from tailrace.plans.sinks import write_results
from tailrace.sources import load_feeds, read_statistics
from tailrace.sources.statistics import select_codes


def run_job(
    spark: SparkSession,
    paths: Mapping[str, Mapping[str, str]],
    statistics_path: str,
    folder: str,
    scenarios: Sequence[Scenario] | None = None,
    as_of: str | None = None,
    on_duplicate: str = "raise",
    fmt: str = "json",
    prefix: str = "",
    codes: Mapping[str, Sequence[str]] | None = None,
) -> None:
    """Read the feeds of each frequency the grid uses, compute all results, write the files.

    paths            frequency -> feed name -> landed files
    statistics_path  landed statistics: coded facts, by code lists or all, see read_statistics()
    prefix           start of the result names
    codes            by coded variable, the codes of the statistics to read; others are read whole
    """
    scenarios = published_grid() if scenarios is None else scenarios
    used = dict.fromkeys(s.freq for s in scenarios)
    feeds = {freq: load_feeds(spark, freq, paths[freq], fmt) for freq in used}
    statistics = select_codes(read_statistics(spark, statistics_path).fact, codes or {})
    with RevenueRun(spark, feeds, statistics, scenarios, as_of, on_duplicate) as run:
        national = run.tables.write(run.national(), "national")
        minimal = run.tables.write(run.minimal(), "minimal")
        write_results(national, minimal, folder, prefix)
