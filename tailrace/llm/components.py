"""Connected components of a graph whose edges stay distributed.

Each round lets every node hold on to the smallest number it sees among its neighbours (first all
its larger neighbours, then its smaller ones), until every edge leads from a node to the smallest
node of its component. Rounds grow with the logarithm of the graph. The tables are written after
each round, so lineage stays short and an executor can be lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.plans.tables import Tables

EDGES = "a long, b long"


def spanning_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) that connect the same nodes, found by label exchange."""
    if not len(a):
        return a, b
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    member = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[member], nodes[label[member]]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by edges that connect the same nodes, at most one per node."""
    for batch in batches:
        a, b = spanning_edges(batch["a"].to_numpy(), batch["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame, tables: Tables, name: str = "components") -> DataFrame:
    """(node, component) of every node that has an edge to another node; the component is its
    smallest node. edges: two columns of long, in either direction, repeats and loops allowed;
    rows with a null are ignored. The result is a written table."""
    a, b = (F.col(c) for c in edges.columns)
    pairs = edges.select(a.alias("a"), b.alias("b")).where("a <> b").mapInArrow(_thinned, EDGES)
    held, turn = tables.write(pairs.distinct(), f"{name}-0"), 0
    while not _all_stars(held):
        turn += 1
        if turn % 2:  # larger neighbours get the smallest one of all
            both = held.union(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
            seen = both.where("b > a").join(low, "a")
        else:  # edges lead from large to small; smaller neighbours get the smallest one
            low = held.groupBy("a").agg(F.min("b").alias("m"))
            seen = held.join(low, "a")
        passed = seen.select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = low.select("a", F.col("m").alias("b"))
        held = tables.write(passed.union(own).where("a <> b").distinct(), f"{name}-{turn}")
        tables.drop(f"{name}-{turn - 1}")
    return held.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _all_stars(edges: DataFrame) -> bool:
    """Every edge leads from a larger node, which has no other, to one without edges of its own."""
    odd = edges.where("a < b").limit(1).count()
    if odd or edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
