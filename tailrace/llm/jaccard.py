"""N-gram Jaccard join: texts whose sets of word shingles are alike, by a size-aware heavy-light join.

Two sets x and y link when |x & y| / |x | y| >= 3/4, so when they share at least c = ceil(3/7 (|x| + |y|))
shingles. Sets are ordered from rare to frequent shingles. Then, for any k up to c, linked sets share k
shingles among the first |x| - ceil(3/4 |x|) + k of each (their k-prefixes). Small (light) sets use
k = 2: they enumerate the pairs of shingles of their 2-prefix, and two light sets meet where they have a
pair in common. Large (heavy) sets use k = 1: they are found by scanning the inverted lists of the
shingles of their 1-prefix, in which light sets that are large enough for a heavy partner stand too. The
boundary is the size at which pairs and lists cost least, from the sets' sizes and the lengths of their
lists. A meeting counts only where the places of the shared shingle leave room for c shared ones; linked
sets have that room at the first shingle they share.

Equal sets are joined as one. Within a list all sets first meet the one with most room, and only sets that
these links leave in different components meet pair by pair; sets that are connected need no further
links, so lists of many near copies stay linear. Every meeting is verified on the whole sets, after
sketches have ruled out most: a set's sketch holds, for each of at least 2 |x| slots of the hashes, whether
an odd number of its shingles fall there. Slots in which two sketches differ each hold a shingle that one
set has alone, so linked sets differ in at most (|x| + |y|) / 7 slots.

The order by frequency needs only the frequent shingles: those seen twice in a task's texts are summed
over all tasks, and the most frequent ORDERED of them are sent to the tasks; the others come first. Any
order gives the same links.

Shingles are 64-bit hashes of SHINGLE words; words are runs of bytes other than white space, A-Z folded. A
text with fewer words is one shingle of all its words; one without words, empty or null, has no set and
is its own component. Rows that repeat a doc_id are texts of their own. The component of a null doc_id is
the smallest known id it is linked with, or null. An empty table gives no rows. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.bytewise import distinct, mixed, runs, shingles, signed, white_space
from tailrace.llm.components import components
from tailrace.llm.workers import give_back, giving_back
from tailrace.plans.tables import Tables

SHINGLE = 5
ORDERED = 1 << 19  # frequent shingles that the order knows
FREQUENT = 8
LARGEST_LIGHT = 32
HELD = 1 << 20  # shingles or prefix entries that a task holds before it sends them out
FILTER_BITS = 25
SLOT_SHINGLES = 1 << 22  # of the sets whose prefixes, a quarter of it, meet in one slot

COUNTED = "kind int, doc_id long, set_id long, n int, shingle long, number long, sketch binary"
PACKED = "slot int, entry binary, owner binary, place binary, set_id binary, n binary"
MEETING = "entry long, pair boolean, set_id long, n int, place int"
SET = "set_id long, n int, shingles binary"


def least_shared(n):
    """ceil(3 n / 4): shingles that a set of n shares with any set it links with, at least."""
    return (3 * n + 3) // 4


def _sets(column: pa.Array) -> Iterator[tuple]:
    """For each run of texts: first row, sizes, set ids, and the distinct (text, shingle) in that order."""
    separators = white_space()
    for run in runs(column):
        begin, end, at = run.words(separators)
        text, value = distinct(*shingles(run.hashes(begin, end, fold=True), at, SHINGLE), run.texts)
        n = np.bincount(text, minlength=run.texts)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(value ^ np.uint64(0x51ED2701)))])
        stop = np.cumsum(n)
        ids = mixed(total[stop] - total[stop - n] + mixed(n.astype(np.uint64)))
        yield run.first, n, ids, text, value


def _sketches(n: np.ndarray, text: np.ndarray, value: np.ndarray) -> list[bytes]:
    """Odd slots of each text's shingles, as bits; the slots are a power of two, by the low bits of hashes."""
    slots = np.array([max(8, 1 << int(2 * x - 1).bit_length()) if x else 0 for x in n.tolist()], np.int64)
    stop = np.cumsum(slots)
    spot = (value & (slots[text] - 1).astype(np.uint64)).astype(np.int64) + (stop - slots)[text]
    bits = np.packbits((np.bincount(spot, minlength=int(slots.sum())) & 1).astype(np.uint8))
    return [bits[a // 8 : b // 8].tobytes() for a, b in zip(stop - slots, stop)]


def _differing(x: np.ndarray, y: np.ndarray) -> int:
    """Slots in which two sketches differ; the longer one is folded to the length of the other."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


@giving_back
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch["n"].to_numpy() + batch["m"].to_numpy()
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
            keep[i] = 7 * _differing(*(np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))) <= n[i]
        kept = batch.filter(pa.array(keep))
        yield kept.select(["a", "b", "first_a", "first_b"])


@giving_back
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 0: a document's set; 1: a shingle of several of the task's sets; 2: of sets of n shingles, the
    number and (as shingle) how many other sets stand in their lists."""

    def batch_of(kind, *columns) -> pa.RecordBatch:
        size = max(len(c) for c in columns if c is not None)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.nulls(size, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds)]
        names = ["kind", "doc_id", "set_id", "n", "shingle", "number", "sketch"]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *arrays], names)

    def lists(held: list) -> Iterator[pa.RecordBatch]:
        value, size = (np.concatenate(x) for x in zip(*held))
        found, where, number = np.unique(value, return_inverse=True, return_counts=True)
        often = number > 1
        yield batch_of(1, None, None, None, signed(found[often]), number[often], None)
        small = size <= LARGEST_LIGHT
        others = np.bincount(size[small], number[where[small]] - 1, LARGEST_LIGHT + 1)
        sets = np.bincount(size[small], 1 / size[small], LARGEST_LIGHT + 1)
        known = np.flatnonzero(sets)
        size = np.rint(sets[known]).astype(np.int64)
        yield batch_of(2, None, None, known, others[known].astype(np.int64), size, None)

    held, total, seen = [], 0, set()
    for batch in batches:
        for first, n, ids, text, value in _sets(batch["text"]):
            rows = batch["doc_id"].slice(first, len(n))
            yield batch_of(0, rows, signed(ids), n, None, None, _sketches(n, text, value))
            fresh = _fresh(ids, seen)
            own = fresh[text]
            held.append((value[own], n[text[own]]))
            total += len(held[-1][0])
            if total >= HELD:
                yield from lists(held)
                held, total, seen = [], 0, set()
    if held:
        yield from lists(held)


def _fresh(ids: np.ndarray, seen: set) -> np.ndarray:
    """Marks the first of each id that is not seen, and adds them."""
    fresh = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if x not in seen:
            seen.add(x)
            fresh[i] = True
    return fresh


def boundary(sizes: list[tuple[int, int, int]], tasks: int) -> int:
    """Smallest size of a heavy set. sizes: for each size up to LARGEST_LIGHT the sets, and how many other sets
    of the same task stand in their lists."""
    gain, best, at = 0.0, 0.0, 3
    for n, sets, others in sorted(sizes):
        if n >= 3:
            lists = n - least_shared(n) + 1
            pairs = (lists + 1) * lists / 2
            gain += sets * lists + others * tasks * lists / n - sets * pairs
            if gain > best:
                best, at = gain, n + 1
    return at


def _prefixes(frequent: np.ndarray, counts: np.ndarray, heavy: int, slots: int):
    """Prefix entries by slot, each set once per task."""
    marks = np.zeros(1 << 22, bool)
    marks[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def ordered(text: np.ndarray, value: np.ndarray) -> np.ndarray:
        often = np.zeros(len(value), np.int64)
        maybe = np.flatnonzero(marks[(value >> np.uint64(42)).astype(np.int64)])
        if len(frequent):
            place = np.minimum(np.searchsorted(frequent, value[maybe]), len(frequent) - 1)
            often[maybe] = np.where(frequent[place] == value[maybe], counts[place], 0)
        return np.argsort(text * (int(often.max(initial=0)) + 1) + often, kind="stable")

    def entries(n: np.ndarray, text: np.ndarray, value: np.ndarray) -> Iterator[tuple]:
        """(entry, text, place) for lists and for pairs; place has the top bit set for pairs."""
        value = value[ordered(text, value)]
        first = np.cumsum(n) - n
        place = np.arange(len(value)) - first[text]
        keep = (place <= n[text] - least_shared(n[text])) & (4 * n[text] >= 3 * heavy) & (n[text] > 2)
        yield value[keep], text[keep], place[keep]
        for size in range(3, heavy):
            sets = np.flatnonzero(n == size)
            if len(sets):
                width = size - least_shared(size) + 2
                left, right = np.triu_indices(width, 1)
                table = value[first[sets][:, None] + np.arange(width)]
                pair = mixed(table[:, left] * np.uint64(3) + mixed(table[:, right]))
                spot = np.broadcast_to(right - 1 + (1 << 30), pair.shape)
                yield pair.ravel(), np.repeat(sets, pair.shape[1]), spot.ravel()

    def send(held: list, sets: list) -> Iterator[pa.RecordBatch]:
        entry, owner, place = (np.concatenate(x) for x in zip(*held))
        ids, n = (np.concatenate(x) for x in zip(*sets))
        slot = ((entry >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        edges = np.searchsorted(slot[order], np.arange(slots + 1))
        columns: list[list] = [[] for _ in range(6)]
        for s in range(slots):
            own = order[edges[s] : edges[s + 1]]
            if len(own):
                known, where = np.unique(owner[own], return_inverse=True)
                values = (entry[own], where.astype(np.uint32), place[own].astype(np.int32), ids[known], n[known].astype(np.int32))
                for column, x in zip(columns, (s, *(v.tobytes() for v in values))):
                    column.append(x)
        names = ["slot", "entry", "owner", "place", "set_id", "n"]
        kinds = [pa.int32(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets, total, base, seen = [], [], 0, 0, set()
        for batch in batches:
            for _, n, ids, text, value in _sets(batch["text"]):
                own = _fresh(ids, seen)[text]
                size = np.bincount(text[own], minlength=len(n))
                for entry, owner, place in entries(size, text[own], value[own]):
                    held.append((entry, owner + base, place))
                    total += len(entry)
                sets.append((ids, n))
                base += len(n)
                if total >= HELD:
                    yield from send(held, sets)
                    held, sets, total, base, seen = [], [], 0, 0, set()
        if total:
            yield from send(held, sets)

    return giving_back(prefixes)


def _meetings(packed: pa.Table) -> pa.Table:
    """The entries of a slot that several sets have."""

    def column(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in packed[name].to_pylist()]

    owner, ids, n = column("owner", np.uint32), column("set_id", np.int64), column("n", np.int32)
    entry, place = np.concatenate(column("entry", np.uint64)), np.concatenate(column("place", np.int32))
    n = np.concatenate([x[o] for x, o in zip(n, owner)])
    ids = np.concatenate([x[o] for x, o in zip(ids, owner)])
    order = np.lexsort((ids, entry))
    entry, place, n, ids = entry[order], place[order], n[order], ids[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry[1:] != entry[:-1]) | (ids[1:] != ids[:-1])
    entry, place, n, ids = entry[new], place[new], n[new], ids[new]
    again = np.zeros(len(entry), bool)
    again[1:] = entry[1:] == entry[:-1]
    again[:-1] |= again[1:]
    entry, place, n, ids = entry[again], place[again], n[again], ids[again]
    pair = place >= 1 << 30
    columns = [signed(entry), pair, ids, n, place & ((1 << 30) - 1)]
    return pa.table(list(map(pa.array, columns)), names=["entry", "pair", "set_id", "n", "place"])


def _slot_meetings(packed: pa.Table) -> pa.Table:
    met = _meetings(packed)
    give_back()
    return met


def _room(a: str, b: str, heavy: int) -> str:
    """SQL: sets a and b can be linked, and this is a list in which they have to meet."""
    return (
        f"4 * least({a}.n, {b}.n) >= 3 * greatest({a}.n, {b}.n)"
        f" AND 7 * least({a}.n - {a}.place, {b}.n - {b}.place) >= 3 * ({a}.n + {b}.n)"
        f" AND ({a}.pair OR greatest({a}.n, {b}.n) >= {heavy})"
    )


def _mark(set_id: np.ndarray, doc_id: np.ndarray, bits: int) -> np.ndarray:
    """Bit of a set in the document that stands for it."""
    return mixed(set_id ^ mixed(doc_id)) >> np.uint64(64 - bits)


def _needed_sets(marks: np.ndarray, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch["doc_id"].fill_null(0).to_numpy().view(np.uint64)
            seen: set = set()
            for first, n, ids, text, value in _sets(batch["text"]):
                slot = _mark(ids, doc_id[first : first + len(n)], bits)
                wanted = ((marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0) & (n > 0)
                rows = np.flatnonzero(wanted)
                rows = rows[_fresh(ids[rows], seen)]
                stop = np.cumsum(n)
                data = [value[stop[i] - n[i] : stop[i]].tobytes() for i in rows]
                columns = [pa.array(signed(ids[rows])), pa.array(n[rows].astype(np.int32)), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["set_id", "n", "shingles"])

    return giving_back(send)


@giving_back
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * shared >= 75 * (len(x) + len(y) - shared)
        kept = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([kept["a"], kept["b"]], ["a", "b"])


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, tables: Tables, name: str) -> DataFrame:
    """The pairs (a, b) of set ids that link. sets: set_id, n, sketch, first (a document). Sketches rule out most; of what is left the sets are read whole,
    each from one document: a bitmap of at most 2 ** FILTER_BITS bits tells the tasks which."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    known = tables.write(sets.join(ids, "set_id", "left_semi"), f"{name}-sketches")
    x = known.select(F.col("set_id").alias("a"), "n", F.col("first").alias("first_a"), F.col("sketch").alias("x"))
    y = known.select(F.col("set_id").alias("b"), F.col("n").alias("m"), F.col("first").alias("first_b"), F.col("sketch").alias("y"))
    left = pairs.join(x, "a").join(y, "b").select("a", "b", "first_a", "first_b", "n", "m", "x", "y")
    left = tables.write(left.mapInArrow(_possible, "a long, b long, first_a long, first_b long"), f"{name}-possible")
    ids = left.select(F.col("a").alias("set_id"), F.col("first_a").alias("first"))
    ids = ids.union(left.select("b", "first_b")).distinct()
    bits = min(FILTER_BITS, max(16, ids.count().bit_length() + 8))
    slot = _bits(ids, bits)
    marks = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(marks, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    whole = tables.write(texts.mapInArrow(_needed_sets(marks, bits), SET), f"{name}-sets")
    whole = whole.dropDuplicates(["set_id"])
    x = whole.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    y = whole.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    both = left.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    links = tables.write(both.mapInArrow(_verified, "a long, b long"), f"{name}-links")
    tables.drop(f"{name}-sketches", f"{name}-possible", f"{name}-sets")
    return links


def _bits(ids: DataFrame, bits: int) -> np.ndarray:
    """The bits to mark, each at most once: at most 2 ** FILTER_BITS numbers reach the driver."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = _mark(*(batch[c].to_numpy().view(np.uint64) for c in ("set_id", "first")), bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32))], ["slot"])

    return ids.mapInArrow(marked, "slot int").distinct().toPandas()["slot"].to_numpy(np.int64)


def frequent_shingles(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, at most ORDERED, and how often they were seen."""
    often = counted.where("kind = 1").groupBy("shingle").agg(F.sum("number").alias("number"))
    often = often.where(F.col("number") >= FREQUENT)
    levels = often.groupBy(F.length(F.bin("number")).alias("level")).count().collect()  # a row per doubling
    total, least = 0, FREQUENT
    for level, count in sorted(((r.level, r["count"]) for r in levels), reverse=True):
        total += count
        if total > ORDERED:
            least = max(least, 1 << level)
            break
    held = often.where(F.col("number") >= least).toPandas()
    shingle = held["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], held["number"].to_numpy(np.int64)[order]


def join_sets(documents: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id, n) of every row, and (a, b): links of set ids that connect what is linked."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = tables.write(texts.mapInArrow(_counted, COUNTED), "counted")
    frequent, counts = frequent_shingles(counted)
    sizes = counted.where("kind = 2").groupBy("n").agg(F.sum("number"), F.sum("shingle")).collect()  # a row per size
    tasks = counted.where("kind = 2").groupBy("n").count().agg(F.max("count")).first()[0] or 1
    heavy = boundary([tuple(r) for r in sizes], tasks)
    # A slot is held by one task, so their number grows with the shingles of all sets.
    whole = counted.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    slots = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), whole // SLOT_SHINGLES)
    packed = texts.select("text").mapInArrow(_prefixes(frequent, counts, heavy, slots), PACKED)
    meetings = tables.write(packed.groupBy("slot").applyInArrow(_slot_meetings, MEETING), "meetings")
    # Each set meets the one with most room in its list.
    most = meetings.groupBy("entry", "pair").agg(
        F.min_by(F.struct("set_id", "n", "place"), F.struct("place", "set_id")).alias("l")
    )
    most = most.select("entry", "pair", "l.*")
    a, b = meetings.alias("a"), most.alias("b")
    met = a.join(b, F.expr(f"a.entry = b.entry AND a.pair = b.pair AND a.set_id <> b.set_id AND {_room('a', 'b', heavy)}"))
    met = met.select(F.least("a.set_id", "b.set_id").alias("a"), F.greatest("a.set_id", "b.set_id").alias("b"))
    stars = tables.write(met.distinct(), "stars")
    sets = counted.where("kind = 0 AND n > 0").groupBy("set_id", "n").agg(
        F.coalesce(F.min("doc_id"), F.lit(0)).alias("first"), F.any_value("sketch").alias("sketch")
    )
    sets = tables.write(sets, "sets")
    links = verified(stars, sets, texts, tables, "stars")
    parts = components(links, tables, "parts")
    # Sets of a list that are still apart meet pair by pair.
    part = F.coalesce("component", "set_id").alias("part")
    marked = meetings.join(parts, meetings["set_id"] == parts["node"], "left").select(*meetings.columns, part)
    marked = tables.write(marked, "marked")
    apart = marked.groupBy("entry", "pair").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    open_ = marked.join(apart.where("low < high").select("entry", "pair"), ["entry", "pair"], "left_semi")
    a, b = open_.alias("a"), open_.alias("b")
    met = a.join(
        b,
        F.expr(f"a.entry = b.entry AND a.pair = b.pair AND a.set_id < b.set_id AND a.part <> b.part AND {_room('a', 'b', heavy)}"),
    )
    met = met.select(F.col("a.set_id").alias("a"), F.col("b.set_id").alias("b")).distinct()
    rest = tables.write(met.join(stars, ["a", "b"], "left_anti"), "rest")
    tables.drop("meetings", "marked")
    links = links.union(verified(rest, sets, texts, tables, "rest"))
    tables.drop("sets")
    return counted.where("kind = 0").select("doc_id", "set_id", "n"), links


def near_copies(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    tables = Tables(documents.sparkSession)
    rows, links = join_sets(documents, tables)
    parts = components(links, tables, "components")
    sets = rows.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    sets = sets.join(parts, sets["set_id"] == parts["node"], "left")
    sets = tables.write(sets.select("set_id", "first", F.coalesce("component", "set_id").alias("part")), "labels")
    smallest = sets.groupBy("part").agg(F.min("first").alias("component_id"))
    labels = sets.join(smallest, "part").select("set_id", F.lit(True).alias("labelled"), "component_id")
    key = F.when(F.col("n") > 0, F.col("set_id"))
    found = rows.withColumn("set_id", key).join(labels, "set_id", "left")
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("labelled"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
