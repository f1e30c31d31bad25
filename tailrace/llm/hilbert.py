"""Shards of documents along a Hilbert curve over their metadata, for pruning of files.

Dimensions are quantised to BITS bits each, in their order: source and language by the bytes after
the prefix that all values share, the size by its logarithm. Nearby points of that grid are close on
the curve, so runs of the curve hold few sources, languages and sizes each, and the range of every
dimension that a reader filters on excludes most files.

Rows are ordered by curve index, inside a cell of the grid by a seeded digest of id, checksum and size (so that
a cell is shuffled, and rows that share an id are spread), and cut in runs whose row counts differ by one at most (law `rows`).

All of it is DataFrame functions. Ranks need no global window: totals are taken by cell and by a
slice of the digest, whose length grows with the cell's rows, and only a slice's rows are ordered
together. Cells are at most 2 ** (3 * BITS), so their table can be broadcast at any input size.

Null source or language comes first in its dimension; a null text has size 1 and no checksum.
Repeated rows take neighbouring slots. An empty table gives no rows. Only doc_id, text, source and lang are read, so
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tailrace.plans.tables import Tables

BITS = 4
SHARDS = 16
# Rows that are ordered together.
SLICE_ROWS = 512


def with_curve(df: DataFrame, point: list[str], bits: int = BITS) -> DataFrame:
    """Adds `curve`, the index of a point on the Hilbert curve, by Skilling's transform: undo the turns
    from the highest bit down, then Gray-decode and interleave. point: names of integer columns of 0
    to 2 ** bits - 1."""
    n = len(point)
    names = [f"__x{i}" for i in range(n)]
    df = df.withColumns({x: F.col(c).cast("int") for x, c in zip(names, point)})
    x = [F.col(c) for c in names]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(n):
            high = x[i].bitwiseAND(1 << bit) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            turned = {names[0]: F.when(high, x[0].bitwiseXOR(F.lit(low))).otherwise(x[0].bitwiseXOR(swap))}
            if i:
                turned[names[i]] = F.when(high, x[i]).otherwise(x[i].bitwiseXOR(swap))
            df = df.withColumns(turned)
    for i in range(1, n):
        df = df.withColumn(names[i], x[i].bitwiseXOR(x[i - 1]))
    flips = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        last = F.shiftright(x[n - 1], bit).bitwiseAND(1)
        flips = flips.bitwiseXOR(last * F.lit((1 << bit) - 1))
    df = df.withColumn("__flips", flips)
    bits_of = [
        F.shiftleft(F.shiftright(c.bitwiseXOR(F.col("__flips")), bit).bitwiseAND(1), bit * n + n - 1 - i)
        for bit in range(bits)
        for i, c in enumerate(x)
    ]
    return df.withColumn("curve", sum(bits_of[1:], bits_of[0])).drop(*names, "__flips")


def text_dimension(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """A text column quantised in its order: null is 0, the rest spread over 1 to 2 ** bits - 1 by the
    six bytes that follow the longest prefix of all values. One aggregate of one row finds the range."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit(0)
    a, b = low.encode(), high.encode()
    shared = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    ends = [int.from_bytes(v[shared : shared + 6].ljust(6, b"\0"), "big") for v in (a, b)]
    part = F.substring(F.encode(F.col(column), "utf-8"), shared + 1, 6)
    number = F.conv(F.rpad(F.hex(part), 12, "0"), 16, 10).cast("long")
    levels = (1 << bits) - 1
    step = F.floor((number - ends[0]) * levels / F.lit(ends[1] - ends[0] + 1))
    return F.when(F.col(column).isNull(), 0).otherwise(1 + step).cast("int")


def size_dimension(size: Column, bits: int = BITS) -> Column:
    """Sizes of at least 1 by their logarithm: a level for each doubling from 32 bytes on."""
    return F.least(F.greatest(F.length(F.bin(size)) - 5, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def shard(df: DataFrame, cell: str, digest: str, ties: list[str], shards: int, tables: Tables) -> DataFrame:
    """Adds shard and slot to the rows of df, which should be a table (it is read three times).

    cell: the curve index, of a bounded number of values. digest: a hexadecimal text. Rows are ordered
    by cell, digest and ties, numbered, and cut in `shards` runs of equal length, give or take a row.
    """
    by_cell = W.orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = df.groupBy(cell).agg(F.count("*").alias("__rows"))
    cells = cells.select(
        cell,
        F.coalesce(F.sum("__rows").over(by_cell), F.lit(0)).alias("__cell_first"),
        F.sum("__rows").over(W.partitionBy()).alias("__total"),
        F.ceil(F.log(16.0, F.greatest(F.col("__rows") / SLICE_ROWS, F.lit(1.0)))).cast("int").alias("__digits"),
    )
    cells = tables.write(cells, "cells")
    rows = df.join(F.broadcast(cells), cell)  # at most one row for each cell of the grid
    rows = rows.withColumn("__slice", F.expr(f"substring({digest}, 1, __digits)"))
    before = W.partitionBy(cell).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    slices = rows.groupBy(cell, "__slice").agg(F.count("*").alias("__rows"))
    slices = slices.select(cell, "__slice", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__slice_first"))
    within = W.partitionBy(cell, "__slice").orderBy(digest, *ties)
    rank = F.col("__cell_first") + F.col("__slice_first") + F.row_number().over(within) - 1
    rows = rows.join(slices, [cell, "__slice"]).withColumn("__rank", rank)
    rows = rows.withColumn("shard", F.expr(f"__rank * {shards} div __total").cast("int"))
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    rows = rows.withColumn("slot", (F.col("__rank") - first).cast("long"))
    return rows.drop("__rows", "__cell_first", "__total", "__digits", "__slice", "__slice_first", "__rank")


def measured(documents: DataFrame, seed: str = "0", *also: str) -> DataFrame:
    """doc_id (and also further columns) with size, checksum, quantised dimensions, curve index and digest of each document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    narrow = documents.select(
        "doc_id",
        *also,
        size.alias("size"),
        F.crc32(F.encode("text", "utf-8")).alias("text_crc32"),
        text_dimension(documents, "source").alias("source_level"),
        text_dimension(documents, "lang").alias("lang_level"),
    )
    # Of id, checksum and size, so that rows that share an id are spread.
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text_crc32", "size")]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *told))
    narrow = narrow.withColumns({"digest": digest, "size_level": size_dimension(F.col("size"))})
    return with_curve(narrow, ["source_level", "lang_level", "size_level"])


def _placed(narrow: DataFrame, shards: int, tables: Tables) -> DataFrame:
    rows = tables.write(narrow, "measured")
    return shard(rows, "curve", "digest", ["doc_id", "text_crc32", "size"], shards, tables)


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: str = "0") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve and the
    quantised dimensions. The texts are read once; what moves is narrow."""
    tables = Tables(documents.sparkSession)
    return _placed(measured(documents, seed), shards, tables).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        "source_level",
        "lang_level",
        "size_level",
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: str = "0") -> DataFrame:
    """Write whole documents as parquet below path, a folder per shard, and return the manifest: per shard its
    rows, bytes and the range of each dimension, for pruning. Every row is written once, rows with null or
    repeated ids and columns of any names included; the folders' names are `shard=0` and so on, so a column
    `shard` of the documents is written as `shard_of_document`."""
    tables = Tables(documents.sparkSession)
    clash = [c for c in documents.columns if c.lower() == "shard"]
    rows = documents.withColumnsRenamed({c: f"{c}_of_document" for c in clash})
    rows = tables.write(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    # Every row of the written table has a number of its own, by which it meets its place.
    placed = tables.write(_placed(measured(rows, seed, "__row"), shards, tables), "placed")
    ordered = rows.join(placed.select("__row", "shard", F.col("slot").alias("__slot")), "__row")
    # Ranges of slots become files, so a shard's size is no task's size.
    ordered = ordered.repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot")
    ordered.drop("__row", "__slot").write.partitionBy("shard").parquet(path)
    return placed.groupBy("shard").agg(
        F.count("*").alias("n_rows"),
        F.sum("size").alias("n_bytes"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("source_level", "lang_level", "size_level") for f in (F.min, F.max)],
    )
