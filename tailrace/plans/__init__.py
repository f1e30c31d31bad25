"""Whole dataflows: the revenue run, its tables and its files."""

from tailrace.plans.run import RevenueRun, calculate
from tailrace.plans.store import FeedStore, StoredRun

__all__ = ["FeedStore", "RevenueRun", "StoredRun", "calculate"]
