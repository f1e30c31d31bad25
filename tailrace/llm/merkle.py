"""Merkle manifest of a dataset: a leaf per document, a tree per group (language), one root.

Where a leaf stands follows from bitmaps, without sorting rows. Each group's doc_ids are bits of 4 KB buckets
(32,768 ids), merged natively with combination before the exchange and kept compressed (a list of the set bits where
they are few). Rows per bucket, summed in steps of 65,536 buckets, give the rank of a bucket's first leaf; the popcount
directory of the bucket's words gives the rank of any id in it. Leaves travel packed, as many as a task read of one
bucket, meet the bucket once, and go to the keyed slot arrays of 1,024 leaves that reduce ten levels at a time. Rows that
share an id are ordered by their leaf: runs of equal leaves are counted, dealt out by the first digits of the leaf and
placed as runs, so no id is a task's load. What is above a block is small and reduced the same way, as is the tree over
the groups, which are numbered by a distributed sort.

leaf   H of the columns, each `-` if null, else its count of UTF-8 bytes, `:` and its value
node   H of up to FANOUT consecutive nodes, a lone one included, until one node remains; a lone leaf is the root
H      lowercase hexadecimal SHA-256 of the concatenated inputs, digests as hexadecimal text

Groups are ordered null first, then bytewise; leaves by doc_id, null first, equal ids by leaf. Rows that repeat all columns
are leaves of their own. An empty table gives no rows. Columns beyond those of COLUMNS are not read, whatever their
names; texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailrace.plans.tables import Tables

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
FANOUT = 2
LEVELS = 10  # reduced at once
BLOCK = FANOUT**LEVELS
BUCKET_BITS = 15  # ids of a bucket, as many as a bitmap of Spark has bits
STEP_BITS = 16  # buckets (and steps of buckets) that one window sums
# Leaves without an id stand before all buckets of ids.
NO_ID = -(1 << 50)
# Leaves gathered before they are packed, and set bits up to which a bitmap is kept as their list.
PACK_ROWS, SPARSE = 1 << 16, 2_048
SLICE_DIGITS = 4  # of a leaf, by which rows of one id are dealt out

STEPS = "array<struct<before: string, after: string>>"
PACK = "grp string, bucket long, lows binary, leaves binary, altered binary, found binary"
PIECE = "grp string, total long, block long, slots binary, ids binary, known binary, leaves binary, altered binary, found binary"
SHARED = "grp string, total long, first long, doc_id long, leaf string, found string"
NODE = "tree string, size long, at long, digest string"


def leaf_of(columns: Mapping[str, Column]) -> Column:
    """The leaf of a row, as hexadecimal text; columns in the order of COLUMNS."""
    texts = [columns[c].cast("string") for c in COLUMNS]
    fields = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*fields), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of the siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


# Tasks ----------------------------------------------------------------------------------------------


def _digests(column: pa.Array) -> np.ndarray:
    """The values of a column of 32-byte binaries that are not null, one a row."""
    values = column.drop_null().cast(pa.binary(32))
    if not len(values):
        return np.zeros((0, 32), np.uint8)
    data = np.frombuffer(values.buffers()[1], np.uint8)
    return data[values.offset * 32 : (values.offset + len(values)) * 32].reshape(-1, 32)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _columns(table: pa.Table) -> dict[str, pa.Array]:
    return {n: table[n].chunk(0) if table[n].num_chunks else table[n].combine_chunks() for n in table.column_names}


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, types[t]) for n, t in (field.split() for field in text.split(", "))])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of one group and bucket as arrays."""
    for table in _gathered(batches, PACK_ROWS):
        c = _columns(table)
        names = c["grp"].dictionary_encode()
        group, bucket = names.indices.to_numpy(), c["bucket"].to_numpy()
        leaves, found = _digests(c["leaf"]), _digests(c["found"])
        altered = c["found"].is_valid().to_numpy(zero_copy_only=False)
        where = np.cumsum(altered) - 1
        order = np.lexsort((bucket, group))
        edges = np.flatnonzero((np.diff(group[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1
        lows = c["low"].to_numpy().astype(np.uint16)
        rows = []
        for own in np.split(order, edges):
            marks = altered[own]
            data = (lows[own], leaves[own], marks.astype(np.uint8), found[where[own[marks]]])
            rows.append((names.dictionary[int(group[own[0]])].as_py(), int(bucket[own[0]]), *[d.tobytes() for d in data]))
        yield _batch(rows, _schema(PACK))


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps with their popcount, and as the list of their set bits where these are few."""
    for batch in batches:
        counts, forms = [], []
        for bits in batch["bits"]:
            words = np.frombuffer(bits.as_buffer(), np.uint64)
            count = int(np.bitwise_count(words).sum())
            few = count <= SPARSE
            forms.append(np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint16).tobytes() if few else words.tobytes())
            counts.append(count)
        columns = [batch["grp"], batch["bucket"], batch["rows"], pa.array(counts, pa.int64()), pa.array(forms, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["grp", "bucket", "rows", "bits", "bitmap"])


def _ranks(bitmap: bytes, count: int, lows: np.ndarray) -> np.ndarray:
    """How many ids of the bucket are smaller."""
    if count <= SPARSE:
        return np.searchsorted(np.frombuffer(bitmap, np.uint16), lows).astype(np.int64)
    words = np.frombuffer(bitmap, np.uint64)
    directory = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    word, bit = lows >> 6, (lows & 63).astype(np.uint64)
    below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
    return directory[word] + np.bitwise_count(below)


def _placed(row: dict) -> tuple[np.ndarray, ...]:
    """Ranks, ids and leaves of a pack, and which of its ids several rows share."""
    lows = np.frombuffer(row["lows"], np.uint16)
    rank = row["first"] + _ranks(row["bitmap"], row["bits"], lows)
    shared = np.zeros(len(lows), bool)
    if row["repeats"]:
        many = np.array([r["low"] for r in row["repeats"]], np.int64)
        more = np.concatenate([[0], np.cumsum([r["n"] - 1 for r in row["repeats"]])])
        rank = rank + more[np.searchsorted(many, lows)]
        shared = np.isin(lows, many)
    known = row["bucket"] != NO_ID
    ids = (row["bucket"] << BUCKET_BITS if known else 0) + lows.astype(np.int64)
    leaves = np.frombuffer(row["leaves"], np.uint8).reshape(-1, 32)
    altered = np.frombuffer(row["altered"], np.uint8).astype(bool)
    found = np.zeros_like(leaves)
    found[altered] = np.frombuffer(row["found"], np.uint8).reshape(-1, 32)
    return rank, ids, np.full(len(ids), known), leaves, altered, found, shared


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of blocks, for leaves whose id no other row has."""
    for batch in batches:
        blocks: dict[tuple, list] = {}
        for row in batch.to_pylist():
            rank, ids, known, leaves, altered, found, shared = _placed(row)
            own = np.flatnonzero(~shared)
            own = own[np.argsort(rank[own])]
            if not len(own):
                continue
            for part in np.split(own, np.flatnonzero(np.diff(rank[own] // BLOCK)) + 1):
                key = (row["grp"], row["total"], int(rank[part[0]] // BLOCK))
                slots = (rank[part] % BLOCK).astype(np.uint16)
                blocks.setdefault(key, []).append((slots, ids[part], known[part], leaves[part], altered[part], found[part][altered[part]]))
        rows = [(*key, *[np.concatenate(c).tobytes() for c in zip(*parts)]) for key, parts in blocks.items()]
        yield _batch(rows, _schema(PIECE))


def _shared_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves whose id other rows have, one a row, with the rank of the first of them."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            rank, ids, known, leaves, altered, found, shared = _placed(row)
            for i in np.flatnonzero(shared):
                other = found[i].tobytes().hex() if altered[i] else None
                doc_id = int(ids[i]) if known[i] else None
                rows.append((row["grp"], row["total"], int(rank[i]), doc_id, leaves[i].tobytes().hex(), other))
        yield _batch(rows, _schema(SHARED))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of blocks, for a run of equal leaves in one block."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            begin = max(row["start"], row["block"] * BLOCK)
            slots = np.arange(begin, min(row["start"] + row["n"], (row["block"] + 1) * BLOCK)) - row["block"] * BLOCK
            n, known = len(slots), row["doc_id"] is not None
            rows.append(
                (
                    row["grp"],
                    row["total"],
                    row["block"],
                    slots.astype(np.uint16).tobytes(),
                    np.full(n, row["doc_id"] if known else 0, np.int64).tobytes(),
                    np.full(n, known, bool).tobytes(),
                    bytes.fromhex(row["leaf"]) * n,
                    np.full(n, row["found"] is not None, np.uint8).tobytes(),
                    bytes.fromhex(row["found"] or "") * n,
                )
            )
        yield _batch(rows, _schema(PIECE))


def _levels(nodes: int) -> int:
    """Levels that one pass reduces in a tree that has so many nodes."""
    levels = 0
    while nodes > 1 and levels < LEVELS:
        nodes = -(-nodes // FANOUT)
        levels += 1
    return levels


def _reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes of every level, these included."""
    found = [nodes]
    for _ in range(levels):
        nodes = found[-1]
        runs = (b"".join(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT))
        found.append([hashlib.sha256(run).hexdigest().encode() for run in runs])
    return found


def _proofs(levels: list[list[bytes]]) -> pa.Array:
    """For each node of the lowest level, the siblings before and after it on every level below the last."""
    count, depth = len(levels[0]), len(levels) - 1
    texts, before, after = [b""], np.zeros((count, depth), np.int64), np.zeros((count, depth), np.int64)
    for level, nodes in enumerate(levels[:-1]):
        for at in range(len(nodes)):
            first = at - at % FANOUT
            below = slice(at * FANOUT**level, (at + 1) * FANOUT**level)
            for column, part in ((before, nodes[first:at]), (after, nodes[at + 1 : first + FANOUT])):
                if part:
                    column[below, level] = len(texts)
                    texts.append(b"".join(part))
    texts = pa.array(texts, pa.binary()).cast(pa.string())
    sides = [texts.take(pa.array(side.ravel())) for side in (before, after)]
    offsets = pa.array(np.arange(count + 1, dtype=np.int32) * depth)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(sides, ["before", "after"]))


def _hexadecimal(digests: bytes) -> list[bytes]:
    text = digests.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _block(pieces: pa.Table) -> pa.Table:
    """A block's slot arrays from its pieces, and the node it reduces to."""
    slots = np.concatenate([np.frombuffer(b, np.uint16) for b in pieces["slots"].to_pylist()])
    n = len(slots)
    ids, known, altered = np.zeros(n, np.int64), np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    leaves, found = np.zeros((n, 32), np.uint8), np.zeros((n, 32), np.uint8)
    joined = {c: b"".join(pieces[c].to_pylist()) for c in ("ids", "known", "leaves", "altered", "found")}
    ids[slots] = np.frombuffer(joined["ids"], np.int64)
    known[slots] = np.frombuffer(joined["known"], np.uint8)
    leaves[slots] = np.frombuffer(joined["leaves"], np.uint8).reshape(-1, 32)
    marks = np.frombuffer(joined["altered"], np.uint8)
    altered[slots] = marks
    found[slots[marks.astype(bool)]] = np.frombuffer(joined["found"], np.uint8).reshape(-1, 32)
    grp, total, block = (pieces[c][0].as_py() for c in ("grp", "total", "block"))
    digest = _reduced(_hexadecimal(leaves.tobytes()), _levels(total))[-1][0].decode()
    arrays = [a.tobytes() for a in (ids, known, leaves, altered, found[altered.astype(bool)])]
    return pa.Table.from_batches([_batch([(grp, total, block, *arrays, digest)], _schema(BLOCKS))])


BLOCKS = "grp string, total long, block long, ids binary, known binary, leaves binary, altered binary, found binary, digest string"


def _climbed(nodes: pa.Table) -> pa.Table:
    """The proofs of a run of nodes, and the node they reduce to."""
    nodes = nodes.sort_by("at")
    levels = _reduced([t.encode() for t in nodes["digest"].to_pylist()], _levels(nodes["size"][0].as_py()))
    parent = pa.array([levels[-1][0].decode()] * nodes.num_rows)
    return nodes.append_column("proof", _proofs(levels)).append_column("parent", parent)


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The leaves of blocks, one a row, with their proof in the block; the rest of it is the block's."""
    for batch in batches:
        c = {n: batch[n] for n in batch.schema.names}
        for row in range(batch.num_rows):
            total, block = c["total"][row].as_py(), c["block"][row].as_py()
            texts = _hexadecimal(c["leaves"][row].as_py())
            found, altered = list(texts), np.frombuffer(c["altered"][row].as_py(), np.uint8).astype(bool)
            for i, text in zip(np.flatnonzero(altered), _hexadecimal(c["found"][row].as_py())):
                found[i] = text
            n = len(texts)
            known = np.frombuffer(c["known"][row].as_py(), np.uint8).astype(bool)
            columns = {
                "grp": pa.repeat(c["grp"][row], n),
                "doc_id": pa.array(np.frombuffer(c["ids"][row].as_py(), np.int64), mask=~known),
                "position": pa.array(block * BLOCK + np.arange(n)),
                "leaf": pa.array(texts, pa.binary()).cast(pa.string()),
                "found_leaf": pa.array(found, pa.binary()).cast(pa.string()),
                "proof": _proofs(_reduced(texts, _levels(total))),
                "rest": c["rest"].take(pa.array(np.full(n, row))),
                "subroot": pa.repeat(c["subroot"][row], n),
                "root": pa.repeat(c["root"][row], n),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


# Plan -----------------------------------------------------------------------------------------------


def _bucket(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, BUCKET_BITS), F.lit(NO_ID))


def _low(doc_id: Column) -> Column:
    return F.coalesce(doc_id.bitwiseAND((1 << BUCKET_BITS) - 1), F.lit(0))


def directory(keys: DataFrame, tables: Tables) -> DataFrame:
    """Per group and bucket: the compressed bitmap, its popcount, the rank of the first leaf, the leaves of the
    group, and the ids that several rows have. keys: grp, bucket and low of every row. A written table."""
    merged = keys.groupBy("grp", "bucket").agg(F.count("*").alias("rows"), F.bitmap_construct_agg("low").alias("bits"))
    form = "grp string, bucket long, rows long, bits long, bitmap binary"
    buckets = tables.write(merged.mapInArrow(_compressed, form), "buckets")
    # Windows over at most 2 ** STEP_BITS buckets, steps, and steps of steps.
    step, far = F.shiftright("bucket", STEP_BITS), F.shiftright("bucket", 2 * STEP_BITS)
    before = lambda by, order: F.coalesce(
        F.sum("rows").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    stepped = buckets.withColumns({"step": step, "far": far})
    steps = stepped.groupBy("grp", "far", "step").agg(F.sum("rows").alias("rows"))
    fars = steps.groupBy("grp", "far").agg(F.sum("rows").alias("rows"))
    fars = fars.withColumns({"far_first": before(["grp"], "far"), "total": F.sum("rows").over(W.partitionBy("grp"))})
    steps = steps.withColumn("step_first", before(["grp", "far"], "step")).drop("rows")
    within = stepped.withColumn("bucket_first", before(["grp", "step"], "bucket"))
    first = F.expr("far_first + step_first + bucket_first")
    ranked = within.join(steps.drop("far"), ["grp", "step"]).join(fars.drop("rows"), ["grp", "far"]).withColumn("first", first)
    ranked = ranked.select("grp", "bucket", "rows", "bits", "bitmap", "first", "total")
    # Most buckets have no repeated id; ids are counted in the others only.
    doubtful = buckets.where("rows > bits").select("grp", "bucket")
    counts = keys.join(doubtful, ["grp", "bucket"], "left_semi").groupBy("grp", "bucket", "low").agg(F.count("*").alias("n"))
    many = counts.where("n > 1").groupBy("grp", "bucket").agg(F.array_sort(F.collect_list(F.struct("low", "n"))).alias("repeats"))
    return tables.write(ranked.join(many, ["grp", "bucket"], "left"), "directory")


def _runs_of_shared(rows: DataFrame) -> DataFrame:
    """The pieces of blocks for rows that share an id: runs of equal leaves, in the order of the leaves."""
    key = ["grp", "first"]
    runs = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    runs = runs.withColumn("slice", F.substring("leaf", 1, SLICE_DIGITS))
    rest = (W.unboundedPreceding, -1)
    slices = runs.groupBy(*key, "slice").agg(F.sum("n").alias("n"))
    over = W.partitionBy(*key).orderBy("slice").rowsBetween(*rest)
    slices = slices.select(*key, "slice", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("slice_first"))
    within = W.partitionBy(*key, "slice").orderBy("leaf", "found").rowsBetween(*rest)
    start = F.col("first") + F.col("slice_first") + F.coalesce(F.sum("n").over(within), F.lit(0))
    placed = runs.join(slices, [*key, "slice"]).withColumn("start", start)
    blocks = F.expr(f"sequence(start div {BLOCK}, (start + n - 1) div {BLOCK})")
    return placed.withColumn("block", F.explode(blocks)).mapInArrow(_runs, PIECE)


def climb(nodes: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(tree, at, proof, root) of the nodes (tree, size, at, digest) of any number of trees; size counts a tree's
    nodes, at counts from 0. A written table."""
    schema = f"{NODE}, proof {STEPS}, parent string"
    levels, largest = [], nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1 or not levels:
        run = F.floor(F.col("at") / BLOCK)
        level = tables.write(nodes.groupBy("tree", run).applyInArrow(lambda t: _climbed(t), schema), f"{name}-{len(levels)}")
        levels.append(level)
        nodes = level.where(f"at % {BLOCK} = 0").select(
            "tree", F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), F.expr(f"at div {BLOCK}").alias("at"), F.col("parent").alias("digest")
        )
        largest = -(-largest // BLOCK)
    above = levels[-1].select("tree", "at", "proof", F.col("parent").alias("root"))
    for level in reversed(levels[:-1]):
        up = above.select("tree", F.col("at").alias("up"), F.col("proof").alias("rest"), "root")
        joined = level.withColumn("up", F.expr(f"at div {BLOCK}")).join(up, ["tree", "up"])
        above = joined.select("tree", "at", F.concat("proof", "rest").alias("proof"), "root")
    return tables.write(above, name)


def _numbered(groups: DataFrame, tables: Tables) -> DataFrame:
    """Adds at, the place of each group in order, and size, their number; sorted by ranges, whatever their number."""
    sorted_ = groups.orderBy("grp").withColumn("__n", F.monotonically_increasing_id())
    held = tables.write(sorted_, "groups").withColumn("__part", F.shiftright("__n", 33))
    parts = held.groupBy("__part").agg(F.count("*").alias("__rows"))  # one row for each partition of the sort
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        "__part",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__first"),
        F.sum("__rows").over(W.partitionBy()).alias("size"),
    )
    low = F.col("__n").bitwiseAND((1 << 33) - 1)
    return held.join(parts, "__part").withColumn("at", F.col("__first") + low).drop("__n", "__part", "__first")


def manifest(documents: DataFrame, found: Mapping[str, Column] | None = None, alter: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, position among the leaves of its language, leaf, proof (siblings before and
    after on each level, from the leaf to the root), subroot, root, and found_leaf, the leaf to check: that of the row with
    the values of `found` in place of its own where `alter` holds, else the leaf itself."""
    tables = Tables(documents.sparkSession)
    names = {c: F.col(c) for c in COLUMNS}
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    rows = documents.select(*COLUMNS)
    keys = rows.select(group.alias("grp"), _bucket(F.col("doc_id")).alias("bucket"), _low(F.col("doc_id")).alias("low"))
    other = F.when(alter, F.unhex(leaf_of({**names, **found}))) if found else F.lit(None).cast("binary")
    hashed = rows.select(
        group.alias("grp"),
        _bucket(F.col("doc_id")).alias("bucket"),
        _low(F.col("doc_id")).alias("low"),
        F.unhex(leaf_of(names)).alias("leaf"),
        other.alias("found"),
    )
    packs = tables.write(hashed.mapInArrow(_packs, PACK), "packs")
    index = directory(keys, tables)
    met = packs.join(index, ["grp", "bucket"])
    pieces = met.mapInArrow(_pieces, PIECE)
    if index.where("repeats is not null").limit(1).count():
        shared = met.where("repeats is not null").mapInArrow(_shared_ids, SHARED)
        pieces = pieces.union(_runs_of_shared(shared))
    blocks = tables.write(pieces.groupBy("grp", "block").applyInArrow(lambda t: _block(t), BLOCKS), "blocks")
    tables.drop("packs", "buckets", "directory")

    count = F.expr(f"(total + {BLOCK - 1}) div {BLOCK}").alias("size")
    above = climb(blocks.select(F.col("grp").alias("tree"), count, F.col("block").alias("at"), "digest"), tables, "above")
    groups = above.where("at = 0").select(F.col("tree").alias("grp"), F.col("root").alias("digest"))
    groups = tables.write(_numbered(groups, tables), "numbered")
    top = climb(groups.select(F.lit("").alias("tree"), "size", "at", "digest"), tables, "top")
    tops = groups.join(top.select("at", F.col("proof").alias("last"), F.col("root").alias("whole")), "at")
    tops = tops.select("grp", F.col("digest").alias("subroot"), "last", "whole")
    paths = above.select(F.col("tree").alias("grp"), F.col("at").alias("block"), F.col("proof").alias("rest"))
    paths = paths.join(tops, "grp").select("grp", "block", F.concat("rest", "last").alias("rest"), "subroot", F.col("whole").alias("root"))

    # Blocks meet their paths packed.
    leaf = f"grp string, doc_id long, position long, leaf string, found_leaf string, proof {STEPS}, rest {STEPS}"
    whole = blocks.drop("digest").join(paths, ["grp", "block"])
    return whole.mapInArrow(_unfolded, f"{leaf}, subroot string, root string").select(
        "doc_id",
        F.expr("if(grp = '', null, substring(grp, 2))").alias("lang"),
        "position",
        "leaf",
        "found_leaf",
        F.concat("proof", "rest").alias("proof"),
        "subroot",
        "root",
    )
