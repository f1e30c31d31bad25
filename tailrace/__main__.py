"""Batch job from a shell: python -m tailrace --help."""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from tailrace.operators.scenarios import Scenario, published_grid
from tailrace.plans.job import run_job

PARAMETERS = [f.name for f in fields(Scenario) if f.name.startswith("param_")]


def main() -> None:
    parser = argparse.ArgumentParser(
        prog="tailrace", description="Hydropower revenue from landed feeds"
    )
    feeds = ("production", "consumption", "prices")
    for feed in feeds:
        help_ = f"path of the landed {feed} feed, one for each frequency"
        parser.add_argument(f"--{feed}", required=True, nargs="+", help=help_)
    parser.add_argument("--statistics", required=True, help="path of the statistics (parquet)")
    parser.add_argument("--out", required=True, help="folder of the result files")
    parser.add_argument("--freq", choices=["daily", "hourly"], nargs="+", default=["hourly"])
    codes = "codes of the statistics to read, as Tid=2021M01,2021M02 (default: all)"
    parser.add_argument("--codes", nargs="+", default=[], help=codes)
    parser.add_argument("--format", choices=["json", "csv", "parquet"], default="json")
    parser.add_argument("--start-date", default="2022-01-01")
    parser.add_argument("--end-date", help="last day of the rows (default: the day after the run)")
    parser.add_argument("--na-rm", choices=["yes", "no"], nargs="+", default=["yes"])
    for name in PARAMETERS:
        option = name.removeprefix("param_").replace("_", "-")
        help_ = "values of the grid (default: those of the published grid, or the usual one)"
        parser.add_argument(f"--{option}", dest=name, type=float, nargs="+", help=help_)
    parser.add_argument("--as-of", help="day of the run (default: today)")
    parser.add_argument("--on-duplicate", choices=["raise", "mean"], default="raise")
    parser.add_argument("--prefix", default="", help="start of the result names")
    args = parser.parse_args()
    if any(len(getattr(args, feed)) != len(args.freq) for feed in feeds):
        parser.error("each feed needs one path for each of --freq")
    wanted = dict(text.split("=", 1) for text in args.codes if "=" in text)
    if len(wanted) < len(args.codes):
        parser.error("--codes takes VARIABLE=CODE,CODE once for each variable")
    run_job(
        SparkSession.builder.appName("tailrace").getOrCreate(),
        {freq: {feed: getattr(args, feed)[i] for feed in feeds} for i, freq in enumerate(args.freq)},
        args.statistics,
        args.out,
        published_grid(
            freq=args.freq,
            start_date=[args.start_date],
            end_date=[args.end_date],
            na_rm=[x == "yes" for x in args.na_rm],
            **{name: getattr(args, name) for name in PARAMETERS if getattr(args, name)},
        ),
        args.as_of,
        args.on_duplicate,
        args.format,
        args.prefix,
        {variable: codes.split(",") for variable, codes in wanted.items()},
    )


if __name__ == "__main__":
    main()
