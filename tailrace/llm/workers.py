"""Memory of Python workers, which outlive their tasks.

Spark keeps an executor's workers for the next tasks. What a task freed stays with the worker, as free memory of
Arrow's pool and of the C library, while the steps after it need that memory for the JVM beside it.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Return the free memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)


def giving_back(task: Callable) -> Callable:
    """A task of batches (for mapInArrow) that gives back free memory when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
