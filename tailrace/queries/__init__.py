"""Queries over the driver tables and their SQL counterparts."""

from tailrace.queries.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
