"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  folder with the driver tables (default /root/testdata/sf0.1)
BENCH_CPUS    local executor threads (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tailrace.queries import QUERIES  # noqa: E402

HEADLINE = [
    "src_prices_daily",
    "src_production_hourly",
    "src_stat_table_labelled",
    "balance_long",
    "balance_wide",
    "balance_wide_hourly",
    "hydro_share_asof",
    "running_total",
    "rev_state",
    "scenario_sweep",
    "scenario_sweep_variants",
    "regional_cumulative_sweep",
    "national_rollup",
    "national_hourly",
    "weekly_cumulative",
    "latest_slice",
    "minimal_output",
    "minimal_output_hourly",
    "sink_roundtrip_csv",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # starts the JVM's readers
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
