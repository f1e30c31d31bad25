"""Readers: landed JSON, CSV and parquet feeds, the region dimension, the statistics table."""

from tailrace.sources.feeds import Feeds, load_feeds
from tailrace.sources.regions import region_dimension
from tailrace.sources.statistics import Statistics, label_codes, metadata_long, read_statistics

__all__ = [
    "Feeds",
    "Statistics",
    "label_codes",
    "load_feeds",
    "metadata_long",
    "read_statistics",
    "region_dimension",
]
