"""Words, shingles and span hashes of whole texts as numpy arrays, one run of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes handled at once; a longer text is handled alone and whole.
RUN_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_codes(fold: bool) -> np.ndarray:
    codes = mixed(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if fold:
        codes[65:91] = codes[97:123]
    return codes


EXACT, FOLDED = _byte_codes(False), _byte_codes(True)


def white_space() -> np.ndarray:
    """By byte: space and the control characters from tab to carriage return."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def no_letter_or_digit() -> np.ndarray:
    """By byte: ASCII that is neither a letter nor a digit; bytes of other scripts count as letters."""
    table = np.ones(256, bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = False
    return table


class Run:
    """Some texts end to end: `bytes`, and where each text begins and ends (`at`, one more than texts)."""

    def __init__(self, first: int, data: np.ndarray, at: np.ndarray):
        self.first, self.bytes, self.at = first, data, at
        self.texts = len(at) - 1
        self._sums: dict[bool, np.ndarray] = {}

    def words(self, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each word, and for each text its first word (one more than texts)."""
        inside = ~separators[self.bytes]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = self.at[:-1] < self.at[1:]
        edge = self.at[:-1][full]
        begins[edge] = inside[edge]
        edge = self.at[1:][full] - 1
        ends[edge] = inside[edge]
        begin = np.flatnonzero(begins)
        return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, self.at)

    def hashes(self, begin: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
        """64-bit hashes of byte spans; fold: A-Z count as a-z."""
        if fold not in self._sums:
            n = len(self.bytes)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self._codes(fold) * _powers(_BASE, n), out=sums[1:])
            self._sums[fold] = sums
        sums = self._sums[fold]
        spans = (sums[end] - sums[begin]) * _powers(_BASE_INVERSE, len(self.bytes) + 1)[begin]
        return mixed(spans + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def _codes(self, fold: bool) -> np.ndarray:
        return (FOLDED if fold else EXACT)[self.bytes]


class WordRun(Run):
    """The texts of a run as words between separators; a word's 64-bit hash stands where a Run has a byte."""

    def __init__(self, run: Run, separators: np.ndarray):
        begin, end, at = run.words(separators)
        super().__init__(run.first, run.hashes(begin, end), at)

    def _codes(self, fold: bool) -> np.ndarray:
        return self.bytes


_power_tables: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    table = _power_tables.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, 1), base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 2 * RUN_BYTES:
            _power_tables[int(base)] = table
    return table[:n]


def runs(column: pa.Array | pa.ChunkedArray, run_bytes: int = RUN_BYTES) -> Iterator[Run]:
    """The texts of an Arrow column in runs of about run_bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + run_bytes, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Run(first, data[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all runs of k words; a shorter text is one shingle, one without words none."""
    counts = np.diff(at)
    text = np.repeat(np.arange(len(counts)), counts)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    starts = np.flatnonzero(np.arange(len(words)) + k <= at[1:][text])
    total = np.zeros(len(starts), np.uint64)
    for j in range(k):
        total += words[starts + j] * factors[j]
    found = [(text[starts], mixed(total))]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        total = np.full(len(short), m, np.uint64)
        for j in range(m):
            total += words[at[short] + j] * factors[j]
        found.append((short, mixed(mixed(total))))
    return np.concatenate([t for t, _ in found]), np.concatenate([h for _, h in found])


def distinct(text: np.ndarray, value: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs in that order."""
    order = np.argsort(value)
    small = text.astype(np.uint16 if texts <= 65_535 else np.int64)
    order = order[np.argsort(small[order], kind="stable")]
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit numbers as Spark's signed ones, bit by bit."""
    return x.view(np.int64)
