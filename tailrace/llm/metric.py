"""Exact range join of vectors by cosine, as a metric join with pivots.

On unit vectors cosine >= c is Euclidean distance <= r = sqrt(2 - 2c), a metric. A bounded sample of
vectors serves as pivots; a vector's home is the cell of its nearest pivot, and each cell is dealt out in blocks of
about BLOCK vectors, so no task holds a cell, however dense it is. A vector moves once, to its block. Blocks meet as whole
rows of the stored table, each two of them once, by a product of its partitions that neither writes nor copies vectors
for the cells they might meet: disk and memory are bounded whatever pivots can part. Where two blocks of cells i and j
meet, a vector x of i can only be linked with a y of j if, by the triangle inequality and as y is nearer to p_j than to p_i,

    d(x, p_j) <= radius of j's block + r   and   d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j)

and the others are left out. What stays is compared in single precision, where that pays along the axes on which a sample
spreads most, beside the length of the rest, whose product bounds what the rest can add; only what that cannot decide is
compared whole, and in double precision. A task sends out, when it ends, link counts and the edges of a spanning forest,
never its pairs.

Equal vectors are joined as one of their number; they are known by 128-bit digests of their components. Vectors that are
null, empty, zero, or hold a null or a non-finite component have no links and are their own component; vectors of
different lengths never link. Rows that repeat a vec_id are vectors of their own, linked by what they hold. The component
of a null vec_id without links to others is null. An empty table gives no rows. Only vec_id and embedding are read, so
other columns may have any name.

What pivots cannot part, as vectors spread evenly in many dimensions, is compared by blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType, LongType, StructField, StructType

from tailrace.llm.components import components, spanning_edges
from tailrace.llm.workers import giving_back
from tailrace.plans.tables import Tables, settings

COSINE = 0.9
BLOCK = 8_192
# A block of long vectors has fewer of them.
BLOCK_BYTES = 1 << 22
# At most so many pivots are sent to the tasks.
PIVOTS = 1_024
SLACK = 1e-7  # for rounding of distances; the cosine itself decides about links
ROWS, COLUMNS = 256, 4_096  # of cosines that are held at once
# A task compares two partitions of blocks: at least so many of them, if there are as many, and of about so many bytes.
PARTITIONS, PARTITION_BYTES = 64, 1 << 26
# Blocks that a task reads, and pairs of them that it gets, at once.
PAIRS = 2
FOUND = "a long, b long, n long"
PLACES = 32  # bits of an id that number the vectors of a block


def _usable(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of the vectors with a direction, by length; kind: of their components."""
    lists = batch["embedding"]
    at = lists.offsets.to_numpy().astype(np.int64)
    held = lists.values.cast(pa.from_numpy_dtype(kind), safe=False)
    missing = np.concatenate([[0], np.cumsum(held.is_null().to_numpy(zero_copy_only=False))])
    held = held.to_numpy(zero_copy_only=False).astype(kind, copy=False)
    sizes = np.diff(at)
    full = lists.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (missing[at[1:]] == missing[at[:-1]])
    for dims in np.unique(sizes[full]):
        rows = np.flatnonzero(full & (sizes == dims))
        vectors = held[at[rows][:, None] + np.arange(dims)] + kind.type(0)  # there is one zero
        own = np.isfinite(vectors).all(1) & vectors.any(1)
        yield rows[own], vectors[own]


def _digests(vectors: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(v, digest_size=16).digest() for v in vectors]


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit rows of vectors of one length."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def _homes(x: np.ndarray, centers: np.ndarray | None) -> np.ndarray:
    """The nearest pivot of each unit row; without pivots of that length there is one cell."""
    if centers is None:
        return np.zeros(len(x), np.int64)
    parts = [(x[i : i + 1_024] @ centers.T).argmax(1) for i in range(0, len(x), 1_024)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _collapsed(digest: list[bytes], first: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of equal digests: the place of one of them, the smallest `first` and the total weight; in order of digests."""
    key = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2)
    order = np.lexsort((key[:, 1], key[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]).any(1)
    start = np.flatnonzero(new)
    if len(start) == len(order):
        return order, first.take(pa.array(order)), weight[order]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least = pa.table({"group": group, "first": first}).group_by("group").aggregate([("first", "min")]).sort_by("group")
    return order[start], least["first_min"].combine_chunks(), np.add.reduceat(weight[order], start)


def _keyed(kind: np.dtype):
    """Every row's vec_id and digest, which is null if its vector has no direction."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest: list[bytes | None] = [None] * batch.num_rows
            for rows, vectors in _usable(batch, kind):
                for row, own in zip(rows, _digests(vectors)):
                    digest[row] = own
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(digest, pa.binary())], ["vec_id", "digest"])

    return key


def _sampled(kind: np.dtype, share: float):
    """About this share of the different vectors, each once per batch."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for _, vectors in _usable(batch, kind):
                for digest, v in zip(_digests(vectors), vectors):
                    if int.from_bytes(digest[:8], "big") < share * 2.0**64:
                        found[digest] = v.tobytes()
            columns = [pa.array(list(x), pa.binary()) for x in (found.keys(), found.values())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "vector"])

    return sample


def _pivots(rows: DataFrame, kind: np.dtype, block: int, cosine: float) -> tuple[dict, dict]:
    """Unit pivots and the axes that come first, by length of vector."""
    total = rows.count()
    count = min(PIVOTS, -(-total // block))
    sample = rows.mapInArrow(_sampled(kind, 4 * PIVOTS / max(total, 1)), "digest binary, vector binary")
    sample = sample.groupBy("digest").agg(F.min("vector").alias("vector")).orderBy("digest").limit(PIVOTS)
    found: dict[int, list[bytes]] = {}
    pivots = {}
    for i, row in enumerate(sample.collect()):
        own = found.setdefault(len(row.vector) // kind.itemsize, [])
        own.append(bytes(row.vector))
        if i < count:
            pivots[len(row.vector) // kind.itemsize] = len(own)
    unit = {dims: _unit(np.frombuffer(b"".join(v), kind).reshape(len(v), dims)) for dims, v in found.items()}
    return {dims: unit[dims][:n] for dims, n in pivots.items()}, {dims: _axes(x, cosine) for dims, x in unit.items()}


def _assigned(kind: np.dtype, pivots: dict[int, np.ndarray], pieces: dict[tuple[int, int], tuple[int, int]] | None):
    """Counts of different vectors by cell, or with pieces (first block and blocks of each cell) the vectors, once per
    batch, and the blocks they go to."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, int], int] = {}
        for batch in batches:
            for rows, vectors in _usable(batch, kind):
                digest, dims = _digests(vectors), vectors.shape[1]
                one, first, weight = _collapsed(digest, batch["vec_id"].take(pa.array(rows)), np.ones(len(rows), np.int64))
                vectors, digest = vectors[one], [digest[i] for i in one]
                home = _homes(_unit(vectors), pivots.get(dims))
                if pieces is None:
                    for cell, n in zip(*np.unique(home, return_counts=True)):
                        counts[dims, int(cell)] = counts.get((dims, int(cell)), 0) + int(n)
                    continue
                base, blocks = np.array([pieces[dims, int(c)] for c in home], np.int64).reshape(-1, 2).T
                part = np.array([int.from_bytes(d[8:], "big") for d in digest], np.uint64) % blocks.astype(np.uint64)
                columns = [base + part.astype(np.int64), np.full(len(home), dims, np.int32), home.astype(np.int32)]
                columns = [*map(pa.array, columns), pa.array(digest, pa.binary()), first, pa.array(weight)]
                columns.append(pa.array([v.tobytes() for v in vectors], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["number", "dims", "cell", "digest", "first", "weight", "vector"])
        if pieces is None:
            cells = [pa.array([x[i] for x in counts], pa.int32()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(list(counts.values()), pa.int64())], ["dims", "cell", "n"])

    return assign


def _packed(members: pa.Table) -> pa.Table:
    """A block as one row; equal vectors of several batches as one."""
    digest = members["digest"].to_pylist()
    one, first, weight = _collapsed(digest, members["first"].combine_chunks(), members["weight"].to_numpy())
    vectors = members["vector"].to_pylist()

    def whole(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), values)

    columns = {c: members[c][:1].combine_chunks() for c in ("number", "dims", "cell")}
    columns |= {"digest": whole(pa.array([digest[i] for i in one], pa.binary())), "first": whole(first)}
    columns |= {"weight": whole(pa.array(weight)), "vector": pa.array([b"".join(vectors[i] for i in one)], pa.binary())}
    return pa.table(columns)


class _Forest:
    """Link counts of the vectors of all blocks that a task has seen, and what is linked, as labels."""

    def __init__(self) -> None:
        self.base: dict[int, int] = {}
        self.id = self.count = self.label = np.zeros(0, np.int64)

    def nodes(self, number: int, size: int) -> np.ndarray:
        if number not in self.base:
            self.base[number] = len(self.id)
            self.id = np.concatenate([self.id, (number << PLACES) + np.arange(size)])
            self.count = np.concatenate([self.count, np.zeros(size, np.int64)])
            self.label = np.concatenate([self.label, np.arange(len(self.label), len(self.label) + size)])
        return self.base[number] + np.arange(size)

    def joined(self, nodes: np.ndarray, part: np.ndarray) -> None:
        """Nodes of the same part are linked."""
        own = self.label[nodes]
        one = np.zeros(len(nodes), np.int64)
        one[part] = own
        self.label = _relabelled(self.label, own, one[part])

    def rows(self) -> pa.RecordBatch:
        linked, member = np.flatnonzero(self.count), np.flatnonzero(self.label != np.arange(len(self.label)))
        none = [pa.nulls(len(x), pa.int64()) for x in (linked, member)]
        a = pa.array(np.concatenate([self.id[linked], self.id[member]]))
        b = pa.concat_arrays([none[0], pa.array(self.id[self.label[member]])])
        return pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.array(self.count[linked]), none[1]])], ["a", "b", "n"])


def _relabelled(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels once those of a and b count as the same."""
    member, smallest = spanning_edges(a, b)
    new = np.arange(int(label.max()) + 1)
    new[member] = smallest
    return new[label]


def _near(x: np.ndarray, own: np.ndarray, other: np.ndarray, radius: float, r: float) -> np.ndarray:
    """Rows x at home with pivot own that can be linked with rows that are at home with other, within radius of it."""
    far, near = (_distances(x, p[None])[:, 0] for p in (other, own))
    apart = float(np.linalg.norm(own - other))
    return np.flatnonzero((far <= radius + r + SLACK) & (far * far - near * near <= 2 * apart * (r + SLACK) + SLACK))


def _axes(x: np.ndarray, cosine: float) -> np.ndarray | None:
    """So many principal axes of unit rows that few pairs without a link pass _leading(); None: too many to be worth it."""
    rows, dims = x.shape
    if rows < 64 or not 16 <= dims <= 4_096:
        return None
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    x = x[:512]
    linked = (x @ x.T >= cosine).sum()
    for k in range(8, 3 * dims // 4, 8):
        leading = _leading(x, axes[:, :k])
        if (leading @ leading.T >= cosine).sum() - linked <= 1e-3 * len(x) ** 2:
            return np.ascontiguousarray(axes[:, :k])
    return None


def _leading(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit rows along some axes, and the length of the rest: their products are cosines or more."""
    along = x @ axes
    rest = np.sqrt(np.maximum(1 - (along * along).sum(1, keepdims=True), 0))
    return np.hstack([along, rest]).astype(np.float32)


def _hits(x: np.ndarray, y: np.ndarray, axes: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) of all pairs of unit rows with that cosine, in parts."""
    whole = x.astype(np.float32), y.astype(np.float32)
    a, b = whole if axes is None else (_leading(x, axes), _leading(y, axes))
    error = (x.shape[1] + 8) * 2.0**-23
    low, high = np.float32(cosine - error), np.float32(cosine + error)
    space = np.empty(ROWS * COLUMNS, np.float32)
    for first in range(0, len(a), ROWS):
        for other in range(0, len(b), COLUMNS):
            p, q = slice(first, first + ROWS), slice(other, other + COLUMNS)
            shape = len(a[p]), len(b[q])
            close = np.matmul(a[p], b[q].T, out=space[: shape[0] * shape[1]].reshape(shape))
            hit = np.flatnonzero(close.ravel() >= low)  # many times as fast as by row and column
            if not len(hit):
                continue
            known = axes is None
            if not known and len(hit) > close.size // 64:
                close, known = np.matmul(whole[0][p], whole[1][q].T, out=close), True
                hit = np.flatnonzero(close.ravel() >= low)
            i, j = np.divmod(hit, shape[1])
            sure = close.ravel()[hit] >= high if known else np.zeros(len(i), bool)
            open_ = np.flatnonzero(~sure)
            i, j = i + first, j + other
            for some in range(0, len(open_), 1 << 14):
                k = open_[some : some + (1 << 14)]
                sure[k] = (x[i[k]] * y[j[k]]).sum(1) >= cosine
            yield i[sure], j[sure]


def _joined(kind: np.dtype, pivots: dict[int, np.ndarray], axes: dict[int, np.ndarray | None], cosine: float, r: float):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Link counts (b null) and spanning edges (n null) of the blocks that a task compares."""
        forest, held = _Forest(), (-1, np.zeros((0, 0)))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i] for c in batch.schema.names}
                dims, cells = row["dims"].as_py(), (row["cell_a"].as_py(), row["cell_b"].as_py())
                numbers = row["a"].as_py(), row["b"].as_py()
                x, y = (
                    held[1] if n == held[0] else _unit(np.frombuffer(row[v].as_buffer(), kind).reshape(-1, dims))
                    for n, v in zip(numbers, ("vector_a", "vector_b"))
                )
                held = numbers[0], x
                weights = [row[w].values.to_numpy() for w in ("weight_a", "weight_b")]
                nodes = [forest.nodes(n, len(v)) for n, v in zip(numbers, (x, y))]
                if cells[0] != cells[1]:
                    own, other = (pivots[dims][c] for c in cells)
                    radius = [_distances(v, p[None]).max() for v, p in ((x, own), (y, other))]
                    picks = _near(x, own, other, radius[1], r), _near(y, other, own, radius[0], r)
                    x, y = x[picks[0]], y[picks[1]]
                    weights, nodes = ([v[p] for v, p in zip(values, picks)] for values in (weights, nodes))
                if not (len(x) and len(y)):
                    continue
                both = np.concatenate(nodes)
                known, part = np.unique(forest.label[both], return_inverse=True)
                parts = len(known)
                for p, q in _hits(x, y, axes.get(dims), cosine):
                    if numbers[0] == numbers[1]:
                        p, q = p[p < q], q[p < q]
                    np.add.at(forest.count, nodes[0][p], weights[1][q])
                    np.add.at(forest.count, nodes[1][q], weights[0][p])
                    p, q = part[p], part[len(x) + q]
                    new = p != q
                    if new.any():
                        part = _relabelled(part, p[new], q[new])
                        parts = 0
                if not parts:
                    forest.joined(both, part)
        yield forest.rows()

    return join


def links(rows: DataFrame, tables: Tables, cosine: float = COSINE, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, digest, first, weight): the different vectors with a direction; (id, n): weight of the other vectors
    linked with id; and (a, b): edges that connect what is linked. rows: vec_id, embedding."""
    r = float(np.sqrt(2 - 2 * cosine))
    kind = _kind(rows)
    pivots, axes = _pivots(rows, kind, block, cosine)
    counts = rows.mapInArrow(_assigned(kind, pivots, None), "dims int, cell int, n long")
    counts = counts.groupBy("dims", "cell").agg(F.sum("n").alias("n")).collect()  # a row per pivot
    pieces, base = {}, 0
    for x in sorted(counts):
        size = max(1, min(block, BLOCK_BYTES // (x.dims * kind.itemsize)))
        pieces[x.dims, x.cell] = base, -(-x.n // size)
        base += pieces[x.dims, x.cell][1]
    id_type = rows.schema["vec_id"].dataType
    fields = [("number", LongType()), ("dims", IntegerType()), ("cell", IntegerType())]
    lists = [("digest", BinaryType()), ("first", id_type), ("weight", LongType())]
    member = StructType([StructField(*f) for f in (*fields, *lists, ("vector", BinaryType()))])
    lists = [(name, ArrayType(own)) for name, own in lists]
    packed = StructType([StructField(*f) for f in (*fields, *lists, ("vector", BinaryType()))])
    members = rows.mapInArrow(giving_back(_assigned(kind, pivots, pieces)), member)
    blocks = tables.write(members.groupBy("number").applyInArrow(_packed, packed), "blocks")
    # Few tasks for few blocks; a task holds the blocks of one partition.
    held = blocks.coalesce(max(PARTITIONS, -(-tables.size("blocks") // PARTITION_BYTES)))
    left, right = (
        held.select("dims", *[F.col(c).alias(f"{c}_{side}") for c in ("cell", "weight", "vector")], F.col("number").alias(side))
        for side in ("a", "b")
    )
    # Each two blocks meet once; which of them is the left one is dealt evenly over the partitions.
    once = (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == ((F.col("a") + F.col("b")) % 2 == 1))
    right = right.withColumnRenamed("dims", "dims_b").hint("shuffle_replicate_nl")
    pairs = left.join(right, once & (F.col("dims") == F.col("dims_b"))).drop("dims_b")
    few = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(PAIRS), "spark.sql.parquet.columnarReaderBatchSize": str(PAIRS)}
    with settings(rows.sparkSession, few):
        found = tables.write(pairs.mapInArrow(giving_back(_joined(kind, pivots, axes, cosine, r)), FOUND), "found")
    nodes = blocks.select("number", F.posexplode(F.arrays_zip("digest", "first", "weight")).alias("place", "own"))
    nodes = nodes.select((F.shiftleft("number", PLACES) + F.col("place")).alias("id"), "own.*")
    linked = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    return nodes, linked, found.where("b is not null").select("a", "b")


def _kind(rows: DataFrame) -> np.dtype:
    """Of the components of vectors; single precision stays what it is."""
    single = isinstance(rows.schema["embedding"].dataType.elementType, FloatType)
    return np.dtype(np.float32 if single else np.float64)


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    tables = Tables(embeddings.sparkSession)
    rows = embeddings.select("vec_id", "embedding")
    nodes, counts, edges = links(rows, tables, cosine, block)
    parts = components(edges, tables).withColumnsRenamed({"node": "id", "component": "part"})
    known = nodes.join(counts, "id", "left").join(parts, "id", "left")
    known = tables.write(known.withColumn("part", F.coalesce("part", "id")), "known")
    smallest = known.groupBy("part").agg(F.min("first").alias("component"))
    labels = known.join(smallest, "part").select(
        F.col("digest").alias("__digest"),
        (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
        "component",
    )
    keyed = StructType().add("vec_id", rows.schema["vec_id"].dataType).add("digest", "binary")
    keyed = rows.mapInArrow(_keyed(_kind(rows)), keyed)
    found = keyed.join(labels, F.expr("digest = __digest"), "left")
    component = F.coalesce("component", "vec_id")
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
