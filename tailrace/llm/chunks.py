"""Removal of line chunks that repeat across documents.

A chunk goes from a line that is not blank to the next such line of its text, with the blank lines
between, so every pair of neighbouring lines is a chunk. It depends on those lines alone: a passage of two
lines or more has all its chunks wherever it stands and whatever surrounds it. Chunks overlap by a line and
are compared over all documents; of equal ones the first stays (smallest doc_id, then place in the text).
A line goes, together with its line end, where it lies in a chunk that repeats an earlier one and in none
that is the first of its kind, so each repeated chunk has a whole copy left. A single line that repeats
between different neighbours stays.

Chunks first meet as 64-bit hashes. A bitmap of FILTER_BITS bits, marked for the hashes that repeat,
tells each task which chunks to send out as bytes; those are grouped by their bytes, so different
chunks with equal hashes stay. At any corpus size the bitmap has that size; should it fill up, more
chunks are sent, with the same result.

Null texts stay null and empty ones empty; both have no chunk. Rows that repeat doc_id and text count as
one document and come out alike. Rows with the same doc_id and different texts are documents of their
own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tailrace.llm.bytewise import Run, runs, signed, white_space
from tailrace.plans.tables import Tables

FILTER_BITS = 22
CHUNK = "doc_id long, text_hash long, chunk int, hash long"


def lines(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each line (without its line end), and for each text its first line; an empty
    text has no line, a line end at the end of a text starts no further one."""
    ends = run.bytes == 10
    last = run.at[1:][run.at[1:] > run.at[:-1]] - 1
    open_ = last[run.bytes[last] != 10] + 1
    end = np.sort(np.concatenate([np.flatnonzero(ends), open_]))
    begin = np.empty_like(end)
    begin[:1] = 0
    begin[1:] = end[:-1] + (run.bytes[np.minimum(end[:-1], max(len(run.bytes) - 1, 0))] == 10)
    # A text that ends without a line end is followed at once by the next text.
    starts = run.at[:-1][run.at[1:] > run.at[:-1]]
    begin[np.searchsorted(begin, starts)] = starts
    return begin, end, np.searchsorted(begin, run.at)


def chunks(run: Run) -> tuple[np.ndarray, ...]:
    """text, first line, last line, begin, end and hash of each chunk."""
    begin, end, at = lines(run)
    text = np.repeat(np.arange(run.texts), np.diff(at))
    ink = np.concatenate([[0], np.cumsum(~white_space()[run.bytes])])
    full = np.flatnonzero(ink[end] > ink[begin])
    same = text[full[1:]] == text[full[:-1]]
    first, last = full[:-1][same], full[1:][same]
    return text[first], first, last, begin[first], end[last], run.hashes(begin[first], end[last])


def _numbered(text: np.ndarray) -> np.ndarray:
    """Place of each chunk in its text."""
    new = np.ones(len(text), bool)
    new[1:] = text[1:] != text[:-1]
    return np.arange(len(text)) - np.maximum.accumulate(np.where(new, np.arange(len(text)), 0))


def _sent(marked: np.ndarray | None):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch["text"]):
                text, _, _, begin, end, spans = chunks(run)
                number, keep = _numbered(text), np.ones(len(text), bool)
                if marked is not None:
                    slot = spans >> np.uint64(64 - FILTER_BITS)
                    keep &= (marked[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                rows = pa.array(run.first + text[keep])
                columns = [batch["doc_id"].take(rows), batch["text_hash"].take(rows)]
                columns += [pa.array(number[keep].astype(np.int32)), pa.array(signed(spans[keep]))]
                names = ["doc_id", "text_hash", "chunk", "hash"]
                if marked is not None:
                    data = run.bytes.tobytes()
                    columns.append(pa.array([data[b:e] for b, e in zip(begin[keep], end[keep])], pa.binary()))
                    names.append("bytes")
                yield pa.RecordBatch.from_arrays(columns, names)

    return send


def repeated_chunks(documents: DataFrame, tables: Tables) -> DataFrame:
    """(doc_id, text_hash, chunk, later) of every chunk that has an equal one; later: it is not their first."""
    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.mapInArrow(_sent(None), CHUNK)
    repeated = found.groupBy("hash").count().where("count > 1")
    slots = repeated.select(F.shiftrightunsigned("hash", 64 - FILTER_BITS).cast("int").alias("slot")).distinct()
    marks = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    slot = slots.toPandas()["slot"].to_numpy(np.int64)  # at most 2 ** FILTER_BITS numbers
    np.bitwise_or.at(marks, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    sent = tables.write(keyed.mapInArrow(_sent(marks), f"{CHUNK}, bytes binary"), "sent")
    place = F.struct("doc_id", "text_hash", "chunk")
    first = sent.groupBy("hash", "bytes").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = first.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    first = tables.write(first, "first").hint("merge")  # plain shuffles on both sides, so that a hot chunk is split
    later = ~place.eqNullSafe(F.col("first"))
    return sent.join(first, ["hash", "bytes"]).select("doc_id", "text_hash", "chunk", later.alias("later"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """documents with the lines of repeated chunks cut out of `text`, and n_lines, n_removed_lines,
    n_removed_bytes; columns of these names are replaced."""
    added = ["n_lines", "n_removed_lines", "n_removed_bytes"]
    names = [c for c in documents.columns if c.lower() not in [*added, "__gone", "__whole"]]
    tables = Tables(documents.sparkSession)
    gone = repeated_chunks(documents, tables).groupBy("doc_id", "text_hash")
    gone = gone.agg(
        F.collect_set(F.when(F.col("later"), F.col("chunk"))).alias("__gone"),
        F.collect_set(F.when(~F.col("later"), F.col("chunk"))).alias("__whole"),
    )
    gone = tables.write(gone.where("size(__gone) > 0"), "gone")
    gone = gone.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    tables.drop("sent", "first")
    match = documents["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(documents["text"]) == gone["__hash"])
    # The lists have no size bound, so they are never broadcast: texts move once at any size.
    rows = documents.join(gone.hint("merge"), match, "left").select(*names, "__gone", "__whole")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, whole = batch["__gone"].to_pylist(), batch["__whole"].to_pylist()
            texts, counts = [], np.zeros((3, batch.num_rows), np.int32)
            for run in runs(batch["text"]):
                begin, _, line_at = lines(run)
                text, first, last, _, _, _ = chunks(run)
                at = np.searchsorted(text, np.arange(run.texts + 1))
                data = run.bytes.tobytes()
                for i in range(run.texts):
                    row, kept = run.first + i, data[run.at[i] : run.at[i + 1]]
                    a, b = line_at[i], line_at[i + 1]
                    counts[0, row] = b - a
                    if gone[row]:
                        edges = np.append(begin[a:b], run.at[i + 1])
                        dropped = np.zeros(b - a, bool)
                        for mark, numbers in ((True, gone[row]), (False, whole[row])):
                            for chunk in at[i] + np.array(numbers, int):
                                dropped[first[chunk] - a : last[chunk] + 1 - a] = mark
                        counts[1, row] = dropped.sum()
                        counts[2, row] = np.diff(edges)[dropped].sum()
                        kept = b"".join(data[edges[j] : edges[j + 1]] for j in np.flatnonzero(~dropped))
                    texts.append(kept)
            new = pa.array(texts, pa.binary(), mask=batch["text"].is_null().to_numpy(zero_copy_only=False)).cast(pa.string())
            kept = [new if c == "text" else batch[c] for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, counts)], [*names, *added])

    schema = StructType([f for f in rows.schema.fields if f.name in names])
    for name in added:
        schema = schema.add(name, "integer")
    return rows.mapInArrow(cut, schema)

