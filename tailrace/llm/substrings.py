"""Removal of long byte strings that occur twice, over whole texts, by suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts anywhere else, in the same text or
another, is removed. Texts are UTF-8 bytes and matches never cross texts.

A window is LENGTH bytes of a text. Its anchor is the position of the smallest 16-byte hash among its
first FLANK + 1 positions (all of them on a tie), so equal windows have their anchors at the same
place. Below an anchor lies its core, the LENGTH - FLANK bytes that all its windows share; with the
bytes left and right of it that its own windows reach, it is a context. Equal windows lie in contexts with
the same core, so contexts are grouped by a hash of their core:

1. Contexts that occur once with a core of their own hold nothing repeated. All windows of a context that
   occurs twice as a whole are repeated. Both is seen from hashes, dealt out by core in packed arrays;
   copies inside one task's texts send one context only.
2. What is left, cores with several contexts, is sent out with the bytes beside the core. A core's
   contexts, the core as one symbol, are joined to a string whose suffix array (see grouping.py) brings
   equal windows next to each other; neighbours are compared symbol by symbol. A core with more than
   UNIT contexts is first split by half of its flanks, which lengthens the cores, until few are left.

Spans of repeated windows then meet their text once and are cut out.

Words go the same way beside the bytes: a passage is PASSAGE words (what white space parts), and what is looked
for are passages that another row has as well, whatever their length in bytes and the space between their words.
A passage that a text holds several times counts where it is first, so equal ones are always of two rows.
In step 2 their windows are compared by 64-bit hashes, without suffix arrays. Nothing is removed for them;
n_shared_words tells how many words of a text lie in such passages.

Null texts are empty. Texts shorter than LENGTH keep all their bytes. Rows that repeat doc_id and text are
texts that repeat each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tailrace.llm.bytewise import Run, WordRun, mixed, runs, signed, white_space
from tailrace.llm.grouping import suffix_arrays
from tailrace.llm.workers import giving_back
from tailrace.plans.tables import Tables

LENGTH = 400
FLANK = 64
PASSAGE = 50
PASSAGE_FLANK = 24
GRAM = 16
UNIT = 24
# Contexts that a task holds before it sends them out.
HELD = 1 << 19
# At most so many bits mark the cores whose contexts are sent out with bytes.
FILTER_BITS = 25
PIECE = 15  # Spark's bitmaps have 2 ** 15 bits
SYMBOLS = 1 << 18  # of strings whose suffix arrays are built in one call

PACKED = (
    "slot int, core binary, context binary, many binary, row binary, doc_id binary, text_hash binary, words binary, "
    "low binary, high binary"
)
SPAN = "doc_id long, text_hash long, words boolean, low int, high int, core long"
STRING = (
    "slot int, core long, many boolean, doc_id long, text_hash long, words boolean, low int, before binary, after binary"
)
SPACE = white_space()
# Windows of bytes and of words: (length, flank) of each.
Sizes = tuple[tuple[int, int], tuple[int, int]]


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every `width` neighbours."""
    span = 1
    y = x
    while span * 2 <= width:
        y = pick(y[: len(y) - span], y[span:])
        span *= 2
    rest = width - span
    return pick(y[: len(y) - rest], y[rest:]) if rest else y


class Contexts:
    """The contexts of a run of texts: text, low (first window, from the text's begin), high (last
    window), at (anchor), and the hashes core and context. once: equal windows of a text count where they
    are first."""

    def __init__(self, run: Run, length: int, flank: int, once: bool = False):
        n = len(run.bytes)
        windows = n - length + 1
        self.length, self.flank = length, flank
        if windows <= 0:
            self.text = self.low = self.high = self.at = np.zeros(0, np.int64)
            self.core = self.context = np.zeros(0, np.uint64)
            return
        gram = min(GRAM, length - flank)
        spots = np.arange(windows + flank)
        x = (run.hashes(spots, spots + gram) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(x, flank + 1, np.minimum)
        inside = np.zeros(windows, bool)
        sizes = np.diff(run.at)
        for text in np.flatnonzero(sizes >= length):
            inside[run.at[text] : run.at[text + 1] - length + 1] = True
        if once:
            inside[_later(run, np.flatnonzero(inside), length)] = False
        least[~inside] = 0
        padded = np.concatenate([np.zeros(flank, np.uint32), least, np.zeros(flank, np.uint32)])
        at = np.flatnonzero(_sliding(padded, flank + 1, np.maximum) == x)
        found = [(at[:0], at[:0], at[:0])]
        for first in range(0, len(at), 1 << 16):
            part = at[first : first + (1 << 16)]
            own = padded[part[:, None] + np.arange(flank + 1)] == x[part][:, None]
            if once:  # an anchor's windows may have gaps, each stretch is a context
                edged = np.zeros((len(part), flank + 3), bool)
                edged[:, 1:-1] = own
                who, low = np.nonzero(edged[:, 1:] & ~edged[:, :-1])
                high = np.nonzero(edged[:, :-1] & ~edged[:, 1:])[1] - 1
                part = part[who]
                found.append((part, part - flank + low, part - flank + high))
            else:
                found.append((part, part - flank + own.argmax(1), part - own[:, ::-1].argmax(1)))
        at, low, high = (np.concatenate(x) for x in zip(*found))
        self.text = np.searchsorted(run.at, at, "right") - 1
        begin = run.at[self.text]
        self.core = run.hashes(at, at + length - flank)
        whole = run.hashes(low, high + length)
        self.context = mixed(whole ^ mixed((at - low).astype(np.uint64) + np.uint64(1)))
        self.low, self.high, self.at = low - begin, high - begin, at - begin


def _later(run: Run, windows: np.ndarray, length: int) -> np.ndarray:
    """The windows that their text holds further left as well."""
    text = np.searchsorted(run.at, windows, "right").astype(np.uint64)
    key = mixed(run.hashes(windows, windows + length) + mixed(text))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return windows[:0]
    spot = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    windows, key = (x[twice[spot] == key] for x in (windows, key))
    return np.delete(windows, np.unique(key, return_index=True)[1])


def _both(run: Run, sizes: Sizes) -> Iterator[tuple[bool, Run, Contexts]]:
    """(words, run, contexts) of a run's bytes and of its words."""
    yield False, run, Contexts(run, *sizes[False])
    words = WordRun(run, SPACE)
    yield True, words, Contexts(words, *sizes[True], once=True)


def _merged(row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joined spans (row, low, high) of windows that follow each other or overlap."""
    order = np.lexsort((low, row))
    row, low, high = row[order], low[order], high[order]
    far = int(high.max(initial=0)) + 2
    reach = np.maximum.accumulate(row * far + high)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (row[1:] * far + low[1:] > reach[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], low[first], (reach[last] - row[first] * far if len(first) else high[:0])


def _counted(core: np.ndarray, context: np.ndarray):
    """For each element the number of its (core, context) and whether it is the first of them."""
    order = np.lexsort((context, core))
    new = np.ones(len(core), bool)
    new[1:] = (core[order][1:] != core[order][:-1]) | (context[order][1:] != context[order][:-1])
    kind = np.empty(len(core), np.int64)
    kind[order] = np.cumsum(new) - 1
    first = np.zeros(len(core), bool)
    first[order[new]] = True
    return np.bincount(kind, minlength=1)[kind] if len(core) else kind, first


def _packed(slots: int, sizes: Sizes):
    """Contexts by slot of their core, once per task; spans of those that repeat inside it. A text's row is
    twice its number, and one more for its words."""

    def rows(held: list, docs: list) -> Iterator[pa.RecordBatch]:
        core, context, row, low, high = (np.concatenate(x) for x in zip(*held))
        doc_id, text_hash = (np.concatenate(x) for x in zip(*docs))
        number, first = _counted(core, context)
        columns: list[list] = [[] for _ in range(10)]

        def add(slot: int, *arrays) -> None:
            at, own = np.unique(arrays[3], return_inverse=True)
            values = (*arrays[:3], own.astype(np.uint32), doc_id[at >> 1], text_hash[at >> 1], at % 2 > 0, *arrays[4:])
            for column, value in zip(columns, (slot, *(v.tobytes() for v in values))):
                column.append(value)

        twice = number > 1
        if twice.any():
            own, a, b = _merged(row[twice], low[twice], high[twice])
            none = np.zeros(0, np.uint64)
            add(int(own[0]) % slots, none, none, np.zeros(0, bool), own, a.astype(np.int32), b.astype(np.int32))
        slot = (core[first] % np.uint64(slots)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        pick, edges = np.flatnonzero(first)[order], np.searchsorted(slot[order], np.arange(slots + 1))
        for s in range(slots):
            own = pick[edges[s] : edges[s + 1]]
            if len(own):
                add(s, core[own], context[own], twice[own], row[own], low[own].astype(np.int32), high[own].astype(np.int32))
        kinds = [pa.int32(), *[pa.binary()] * 9]
        names = ["slot", "core", "context", "many", "row", "doc_id", "text_hash", "words", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size, base = [], [], 0, 0
        for batch in batches:
            docs.append(_keys(batch))
            for run in runs(batch["text"]):
                for words, _, c in _both(run, sizes):
                    held.append((c.core, c.context, 2 * (base + run.first + c.text) + words, c.low, c.high))
                    size += len(c.core)
            base += batch.num_rows
            if size >= HELD:
                yield from rows(held, docs)
                held, docs, size, base = [], [], 0, 0
        if held:
            yield from rows(held, docs)

    return pack


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "text_hash"))


def _spans(doc_id, text_hash, words, low, high, core=None) -> pa.Table:
    core = pa.nulls(len(low), pa.int64()) if core is None else core
    columns = [doc_id, text_hash, words, low.astype(np.int32), high.astype(np.int32)]
    return pa.table([*map(pa.array, columns), core], names=["doc_id", "text_hash", "words", "low", "high", "core"])


def _from_hashes(packed: pa.Table) -> pa.Table:
    """A slot's spans of contexts that occur twice, and the cores (low is null) whose bytes are needed."""

    def column(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in packed[name].to_pylist()]

    docs, hashes, words = column("doc_id", np.int64), column("text_hash", np.int64), column("words", bool)
    base = np.cumsum([0, *(len(d) for d in docs)])
    row = [r.astype(np.int64) + b for r, b in zip(column("row", np.uint32), base)]
    core, context, many = column("core", np.uint64), column("context", np.uint64), column("many", bool)
    low, high = column("low", np.int32), column("high", np.int32)
    docs, hashes, words = (np.concatenate(x) for x in (docs, hashes, words))
    known = [len(c) == 0 for c in core]  # spans that a task has found itself
    parts = [(r, a, b) for r, a, b, k in zip(row, low, high, known) if k]
    fresh = [x for x in zip(row, core, context, many, low, high) if len(x[1])]
    needed = np.zeros(0, np.uint64)
    if fresh:
        row, core, context, many, low, high = (np.concatenate(x) for x in zip(*fresh))
        number, first = _counted(core, context)
        again = (number > 1) & ~many
        parts.append((row[again], low[again], high[again]))
        order = np.argsort(core, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], core[order][1:] != core[order][:-1]]))
        kinds = np.add.reduceat(first[order].astype(int), start)
        alone = np.add.reduceat(((number == 1) & ~many)[order].astype(int), start)
        needed = core[order][start][(kinds > 1) & (alone > 0)]
    row, low, high = (np.concatenate(x) for x in zip(*parts))
    found = _spans(docs[row], hashes[row], words[row], low, high)
    none = [pa.nulls(len(needed), kind) for kind in found.schema.types[:-1]]
    return pa.concat_tables([found, pa.table([*none, pa.array(signed(needed))], names=found.column_names)])


def _with_bytes(marks: np.ndarray, bits: int, slots: int, sizes: Sizes):
    """The contexts of marked cores with the bytes left and right of the core, or for words with the hashes of
    their windows; equal ones once per task."""
    names = ["slot", "core", "many", "doc_id", "text_hash", "words", "low", "before", "after"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, text_hash = _keys(batch)
            for words, run, c in (x for whole in runs(batch["text"]) for x in _both(whole, sizes)):
                length, flank = sizes[words]
                slot = c.core >> np.uint64(64 - bits)
                wanted = (marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
                pick = np.flatnonzero(wanted)
                number, first = _counted(c.core[pick], c.context[pick])
                pick, many = pick[first], number[first] > 1
                begin = run.at[c.text[pick]]
                a, b, e = begin + c.low[pick], begin + c.at[pick], begin + c.high[pick] + length
                if words:
                    before, after = _window_hashes(run, a, b, e, length), [b""] * len(pick)
                else:
                    data = run.bytes.tobytes()
                    before = [data[x:y] for x, y in zip(a, b)]
                    after = [data[y + length - flank : z] for y, z in zip(b, e)]
                row = run.first + c.text[pick]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(((c.core[pick] // np.uint64(slots)) % np.uint64(slots)).astype(np.int32)),
                        pa.array(signed(c.core[pick])),
                        pa.array(many),
                        pa.array(doc_id[row]),
                        pa.array(text_hash[row]),
                        pa.array(np.full(len(pick), words)),
                        pa.array(c.low[pick].astype(np.int32)),
                        pa.array(before, pa.binary()),
                        pa.array(after, pa.binary()),
                    ],
                    names,
                )

    return send


def _window_hashes(run: Run, low: np.ndarray, anchor: np.ndarray, end: np.ndarray, length: int) -> list[bytes]:
    """For each context from low to end the hashes of its windows and of the way from each to the anchor, end to
    end; so a window with several anchors is not taken for two."""
    count = end - low - length + 1
    edge = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(edge[-1]) + np.repeat(low - edge[:-1], count)
    way = (np.repeat(anchor, count) - at).astype(np.uint64)
    data = mixed(run.hashes(at, at + length) ^ mixed(way + np.uint64(1))).tobytes()
    return [data[x:y] for x, y in zip(8 * edge[:-1], 8 * edge[1:])]


def _squeezed(core, before, n_before, after, n_after, alone):
    """Equal strings of a core as one: which of them stands for each, and for which all windows repeat."""
    weigh = mixed(np.arange(1, 2 + before.shape[1] + after.shape[1], dtype=np.uint64)) | np.uint64(1)
    key = (before.astype(np.uint64) * weigh[: before.shape[1]]).sum(1, dtype=np.uint64)
    key += (after.astype(np.uint64) * weigh[before.shape[1] : -1]).sum(1, dtype=np.uint64)
    key = mixed(key + mixed((n_before * 1000 + n_after + 1).astype(np.uint64)))
    number, first = _counted(core, key)
    return key, (number > 1) | ~alone, first


def repeated_windows(core, before, n_before, after, n_after, alone, flank: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) of all windows that occur in two contexts of their core. Window w of a context has
    w bytes left of the core and flank - w right of it.

    before and after: matrices of bytes + 3, 0 where there is none; before ends at its right edge, after begins
    at its left. alone: whether the context stands for itself only; windows of others repeat anyway."""
    found = []
    whose = np.arange(len(core))
    part = (core, before, n_before, after, n_after, alone, whose, flank, 0)
    parts = [part]
    while parts:
        core, before, n_before, after, n_after, alone, whose, width, shift = parts.pop()
        fits = (n_before + n_after >= width)
        core, before, n_before, after, n_after, alone, whose = (
            x[fits] for x in (core, before, n_before, after, n_after, alone, whose)
        )
        if not len(core):
            continue
        _, again, first = _squeezed(core, before, n_before, after, n_after, alone)
        least, most = np.maximum(0, width - n_after), np.minimum(n_before, width)
        count = (most - least + 1)[again]
        if again.any():
            w = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(least[again], count)
            found.append((np.repeat(whose[again], count), w + shift))
        core, before, n_before, after, n_after, again, whose = (
            x[first] for x in (core, before, n_before, after, n_after, again, whose)
        )
        _, kind, kinds = np.unique(core, return_inverse=True, return_counts=True)
        open_ = np.bincount(kind, ~again)[kind] > 0 if len(core) else np.zeros(0, bool)
        few = (kinds[kind] > 1) & (kinds[kind] <= UNIT) & open_
        if width <= 2:
            few = (kinds[kind] > 1) & open_
        own = np.flatnonzero(few)
        own = own[np.argsort(core[own], kind="stable")]
        for some in _portions(core[own], n_before[own] + n_after[own] + 2):
            i = own[some]
            who, w = _by_suffix_array(core[i], before[i], n_before[i], after[i], n_after[i], width)
            found.append((whose[i][who], w + shift))
        more = (kinds[kind] > UNIT) & open_ & ~few
        if more.any():
            half = width // 2
            x = (core[more], before[more], n_before[more], after[more], n_after[more], ~again[more], whose[more])
            parts += _split(*x, width, half, shift)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    who, w = (np.concatenate(x) for x in zip(*found))
    both = np.unique(who * (flank + 1) + w)
    return both // (flank + 1), both % (flank + 1)


def _split(core, before, n_before, after, n_after, alone, whose, width: int, half: int, shift: int) -> list[tuple]:
    """Windows with at most `half` bytes left of the core have the first width - half bytes right of it in
    common; those with at least `half` the last half bytes left of it."""
    rest = width - half
    weigh = mixed(np.arange(7, 7 + width, dtype=np.uint64)) | np.uint64(1)
    columns = before.shape[1]
    right = n_after >= rest
    key = (after[:, :rest].astype(np.uint64) * weigh[:rest]).sum(1, dtype=np.uint64)
    left = n_before >= half
    other = (before[:, columns - half :].astype(np.uint64) * weigh[:half]).sum(1, dtype=np.uint64)
    low = (
        mixed(core + mixed(key) + np.uint64(width)), before[:, columns - half :], np.minimum(n_before, half),
        after[:, rest:], n_after - rest, alone, whose,
    )
    high = (
        mixed(core ^ mixed(other + np.uint64(width))), before[:, : columns - half], n_before - half,
        after[:, :rest], np.minimum(n_after, rest), alone, whose,
    )
    return [
        (*(x[right] for x in low), half, shift),
        (*(x[left] for x in high), rest, shift + half),
    ]


def _portions(core: np.ndarray, sizes: np.ndarray) -> Iterator[slice]:
    """Runs of whole cores of about SYMBOLS symbols."""
    if not len(core):
        return
    edges = np.append(np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]])), len(core))
    total = np.concatenate([[0], np.cumsum(sizes)])
    first = 0
    while first < len(edges) - 1:
        last = int(np.searchsorted(total[edges], total[edges[first]] + SYMBOLS, "right")) - 1
        last = min(max(last, first + 1), len(edges) - 1)
        yield slice(edges[first], edges[last])
        first = last


def _by_suffix_array(core, before, n_before, after, n_after, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, window) of the windows that occur in two strings of one core; strings sorted by core.

    A core's strings are put end to end with 1 behind each and 2 for the core itself."""
    k, columns = before.shape
    table = np.zeros((k, columns + after.shape[1] + 2), np.uint16)
    table[:, :columns] = before
    table[:, columns] = 2
    table[:, columns + 1 : -1] = after
    rows = np.arange(k)
    table[rows, columns + 1 + n_after] = 1
    spot = np.arange(table.shape[1])
    used = (spot >= (columns - n_before)[:, None]) & (spot <= (columns + 1 + n_after)[:, None])
    symbols = table[used]
    sizes = n_before + n_after + 2
    at = np.concatenate([[0], np.cumsum(sizes)])
    new = np.flatnonzero(np.concatenate([[True], core[1:] != core[:-1]]))
    ordered = suffix_arrays(symbols, np.append(at[new], at[-1]))
    string = np.repeat(rows, sizes)
    place = np.arange(len(symbols)) - at[:-1][string]
    starts = (place <= n_before[string]) & (place + width + 1 < sizes[string]) & (n_before[string] - place <= width)
    ordered = ordered[starts[ordered]]
    if len(ordered) < 2:
        return rows[:0], rows[:0]
    unit = np.repeat(np.arange(len(new)), np.diff(np.append(new, k)))[string[ordered]]
    same = unit[1:] == unit[:-1]
    windows = np.lib.stride_tricks.sliding_window_view(symbols, width + 1)
    for first in range(0, len(same), 1 << 15):
        part = slice(first, first + (1 << 15))
        a, b = ordered[:-1][part], ordered[1:][part]
        check = np.flatnonzero(same[part])
        same[part][check] = (windows[a[check]] == windows[b[check]]).all(1)
    hit = np.zeros(len(ordered), bool)
    hit[1:] |= same
    hit[:-1] |= same
    ordered = ordered[hit]
    return string[ordered], (n_before[string] - place)[ordered]


def _matrix(column: pa.ChunkedArray, flank: int, right: bool) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of bytes + 3, flush left or right, and their lengths."""
    strings = column.to_pylist()
    sizes = np.array([len(x) for x in strings], np.int64)
    table = np.zeros((len(strings), flank), np.uint16)
    spot = np.arange(flank)
    used = spot >= (flank - sizes)[:, None] if right else spot < sizes[:, None]
    table[used] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 3
    return table, sizes


def _from_bytes(flank: int):
    def find(strings: pa.Table) -> pa.Table:
        """Spans of the windows of a slot's contexts that repeat."""
        words = strings["words"].combine_chunks()
        return pa.concat_tables([by_suffixes(strings.filter(pc.invert(words))), _by_hashes(strings.filter(words))])

    def by_suffixes(strings: pa.Table) -> pa.Table:
        before, n_before = _matrix(strings["before"], flank, True)
        after, n_after = _matrix(strings["after"], flank, False)
        core = strings["core"].to_numpy().view(np.uint64)
        alone = ~strings["many"].to_numpy().astype(bool)
        who, window = repeated_windows(core, before, n_before, after, n_after, alone, flank)
        # A context's windows start at its low; its first one has all of `before` left of the core.
        low = strings["low"].to_numpy().astype(np.int64)[who] + n_before[who] - window
        return _found(strings, *_merged(who, low, low))

    return find


def _by_hashes(strings: pa.Table) -> pa.Table:
    """The same for words, whose contexts come with the hashes of their windows."""
    sent = strings["before"].to_pylist()
    window = np.frombuffer(b"".join(sent), np.uint64)
    count = np.array([len(x) // 8 for x in sent], np.int64)
    who = np.repeat(np.arange(len(count)), count)
    low = strings["low"].to_numpy().astype(np.int64)[who] + np.arange(len(who)) - (np.cumsum(count) - count)[who]
    _, kind, number = np.unique(window, return_inverse=True, return_counts=True)
    hit = (number[kind] > 1) | strings["many"].to_numpy().astype(bool)[who]
    return _found(strings, *_merged(who[hit], low[hit], low[hit]))


def _found(strings: pa.Table, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Table:
    return _spans(*(strings[c].to_numpy()[row] for c in ("doc_id", "text_hash", "words")), low, high)


def _marked(cores: DataFrame, bits: int) -> np.ndarray:
    """Bits marked for the first bits of all cores. Executors set them, in pieces of PIECE, so the driver gets
    2 ** bits bits at most and no cores."""
    slot = cores.select(F.shiftrightunsigned("core", 64 - bits).alias("slot"))
    piece = slot.groupBy(F.shiftrightunsigned("slot", PIECE).cast("int").alias("piece"))
    marks = np.zeros((1 << (bits - PIECE), 1 << (PIECE - 3)), np.uint8)
    for row in piece.agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << PIECE) - 1)).alias("marks")).collect():
        marks[row.piece] = np.frombuffer(row.marks, np.uint8)
    return marks.ravel()


def repeated_spans(documents: DataFrame, tables: Tables, sizes: Sizes) -> DataFrame:
    """(doc_id, text_hash, words, low, high): ranges of begins of windows that occur twice, counted in bytes or
    words."""
    spark = documents.sparkSession
    slots = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = documents.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("text_hash"), "text"
    )
    packed = keyed.mapInArrow(giving_back(_packed(slots, sizes)), PACKED)
    spans = tables.write(packed.groupBy("slot").applyInArrow(_from_hashes, SPAN), "spans")
    cores = spans.where("low is null")
    bits = min(FILTER_BITS, max(16, cores.count().bit_length() + 4))
    marks = _marked(cores, bits)
    sent = keyed.mapInArrow(giving_back(_with_bytes(marks, bits, slots, sizes)), STRING)
    # Cores sent because they share a mark with a needed one fall out here, or stay without effect.
    exact = tables.write(sent.groupBy("slot").applyInArrow(_from_bytes(sizes[False][1]), SPAN), "exact")
    return spans.where("low is not null").union(exact).drop("core")


def cut_repeats(
    documents: DataFrame,
    length: int = LENGTH,
    flank: int = FLANK,
    passage: int = PASSAGE,
    passage_flank: int = PASSAGE_FLANK,
) -> DataFrame:
    """documents with kept (the remaining bytes), n_bytes, n_removed, n_spans and n_shared_words (words in
    passages that another row has as well, a text's equal passages counted once); columns of these names are
    replaced."""
    added = ["kept", "n_bytes", "n_removed", "n_spans", "n_shared_words"]
    sizes = ((length, flank), (passage, passage_flank))
    names = [c for c in documents.columns if c.lower() not in [*added, "__spans"]]
    tables = Tables(documents.sparkSession)
    spans = repeated_spans(documents, tables, sizes).groupBy("doc_id", "text_hash")
    spans = spans.agg(F.collect_list(F.struct("low", "high", "words")).alias("__spans"))
    spans = spans.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    match = (F.coalesce(documents["doc_id"], F.lit(0)) == spans["__id"]) & (
        F.xxhash64(documents["doc_id"], documents["text"]) == spans["__hash"]
    )
    rows = documents.join(spans, match, "left").select(*names, "__spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, counts = [], np.zeros((4, batch.num_rows), np.int64)
            lists = batch["__spans"]
            for run in runs(batch["text"]):
                for i in range(run.texts):
                    row = run.first + i
                    whole = run.bytes[run.at[i] : run.at[i + 1]]
                    counts[0, row] = len(whole)
                    own = lists[row]
                    if own.is_valid:
                        low, high = (own.values.field(j).to_numpy().astype(np.int64) for j in (0, 1))
                        words = own.values.field(2).to_numpy(zero_copy_only=False).astype(np.int64)
                        kind, low, high = _merged(words, low, high + np.where(words, passage, length) - 1)
                        shared = kind > 0
                        counts[3, row] = (high - low + 1)[shared].sum()
                        low, high = low[~shared], high[~shared]
                        counts[1, row] = (high - low + 1).sum()
                        counts[2, row] = len(low)
                        gone = np.zeros(len(whole) + 1, np.int32)
                        gone[low] += 1
                        gone[high + 1] -= 1
                        whole = whole[np.cumsum(gone)[:-1] == 0]
                    kept.append(whole.tobytes())
            columns = [batch[c] for c in names] + [pa.array(kept, pa.binary()), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    schema = StructType([f for f in rows.schema.fields if f.name in names]).add("kept", "binary")
    for name in added[1:]:
        schema = schema.add(name, "long")
    return rows.mapInArrow(giving_back(cut), schema)
