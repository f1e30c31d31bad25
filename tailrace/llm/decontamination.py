"""Benchmark passages in documents, found by their edit distance.

Texts are words (letters and digits in lower case). Spaces, punctuation and symbols of any script part words, and in
scripts without spaces (Han, Kana, Thai and others) each character is a word. A document holds an item if some run of its
words is at most EDITS of the item's words away in word insertions, deletions and substitutions.

Windows of a document's words, as long as an item and its edits, are embedded by the CGK random walk: step
j writes the word at the pointer and moves on or not, as a random bit of (j, word) says. Two walks over
similar windows fall in step again after an edit, so a small edit distance becomes a small Hamming
distance. Keys of some sampled steps are looked up among those of the items (locality-sensitive hashing
by bit sampling), over so many walks that an item with the most edits allowed is found with probability
RECALL: the rate of one walk is measured for each class of items on edited copies of its own items. Each
candidate is then verified with the exact edit distance. Where walks find none of those copies, keys say nothing, and
all windows that the next step leaves are verified.

Before that, windows are left out that cannot match: an item with e edits keeps all but q * e of its runs
of q words, so a window with fewer of its class's runs in it is none (q is 3, less for short items).

The benchmark is read in blocks of at most BLOCK_BYTES, each sent to the tasks; documents are scanned once
for each block and do not move, so their number, copies and hot sources cost what they weigh.

Null and empty texts hold nothing, and items without words are in nothing. Items with the same words are
matched each. Repeated documents are matched each. Empty tables give no matches. Documents keep all columns, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.bytewise import Run, mixed, no_letter_or_digit, runs
from tailrace.llm.workers import giving_back

EDITS = 0.2
RECALL = 0.98
SAMPLED = 2  # steps in a key
KEYS = 4  # keys of a walk
TRIES = 16  # walks over each copy that measure the rate, so a rate that is not 0 needs 63 walks at most
MOST_WALKS = 64
BLOCK_BYTES = 4 << 20
# Unicode ranges (of RE2) of spaces, punctuation and symbols, and of scripts without spaces.
PARTING = (
    r"[\x{80}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{1680}\x{2000}-\x{206F}\x{20A0}-\x{20CF}"
    r"\x{2190}-\x{2BFF}\x{2E00}-\x{2E7F}\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{303D}\x{30FB}\x{FE10}-\x{FE6F}"
    r"\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}\x{FF3B}-\x{FF40}\x{FF5B}-\x{FF65}\x{1F000}-\x{1FAFF}]+"
)
SINGLE = (
    r"([\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{2FDF}\x{3005}-\x{3007}\x{3021}-\x{302F}"
    r"\x{3031}-\x{303C}\x{3040}-\x{30FA}\x{30FC}-\x{312F}\x{31A0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}])"
)
GROWTH = 1.25  # lengths of the items of a class differ by this factor at most
MATCH = "doc_id long, item_id long, edits int, item_words int, first_word int, n_words int"


@dataclass
class Class_:
    """Items of similar length: their numbers, words, and what finds them."""

    items: np.ndarray
    words: list[np.ndarray]
    shortest: int
    longest: int
    edits: int
    run: int
    least: int  # runs of `run` words that a matching window has at least
    marks: np.ndarray
    steps: np.ndarray | None  # walks x KEYS x SAMPLED; None: keys say nothing
    keys: np.ndarray
    owner: np.ndarray


def allowed(n: int, share: float = EDITS) -> int:
    return int(n * share)


def walk(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, steps: np.ndarray) -> np.ndarray:
    """Keys (starts x keys) of one CGK walk from each start; behind its end a window reads 0."""
    last = int(steps.max()) + 1
    wanted = {int(s): np.nonzero(steps == s) for s in np.unique(steps)}
    pointer = starts.copy()
    read = np.zeros((len(starts), *steps.shape), np.uint64)
    salt = mixed(np.arange(last, dtype=np.uint64) + np.uint64(1 + (seed << 20)))
    for j in range(last):
        word = np.where(pointer < ends, words[np.minimum(pointer, len(words) - 1)], np.uint64(0))
        if j in wanted:
            a, b = wanted[j]
            read[:, a, b] = word[:, None]
        bits = (word ^ salt[j]) * np.uint64(0x9E3779B97F4A7C15)
        pointer += (bits >> np.uint64(63)).astype(pointer.dtype)
    factors = mixed(np.arange(1, steps.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
    key = (read * factors).sum(2, dtype=np.uint64)
    return mixed(key + mixed(np.arange(steps.shape[0], dtype=np.uint64) + np.uint64(seed * 64 + 1)))


def _edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = list(words)
    for _ in range(edits):
        at, what = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        new = np.uint64(rng.integers(1, 1 << 62))
        if what == 0 or at >= len(out):
            out.insert(at, new)
        elif what == 1 and len(out) > 1:
            del out[at]
        else:
            out[at] = new
    return np.array(out, np.uint64)


def parted(column: pa.Array) -> pa.Array:
    """Texts in lower case whose words are parted by ASCII alone."""
    lower = pc.utf8_lower(column)
    return pc.replace_substring_regex(pc.replace_substring_regex(lower, PARTING, " "), SINGLE, r" \1 ")


def _class(items: np.ndarray, words: list[np.ndarray], share: float, recall: float) -> Class_:
    sizes = [len(w) for w in words]
    shortest, longest = min(sizes), max(sizes)
    edits = allowed(longest, share)
    run = max(1, min(3, *((n - allowed(n, share)) // (allowed(n, share) + 1) for n in sizes)))
    least = max(1, min(n - run + 1 - allowed(n, share) * run for n in sizes))
    grams = np.concatenate([_runs_of(w, run) for w in words])
    bits = max(16, int(len(grams)).bit_length() + 8)
    marks = np.zeros(1 << bits, bool)
    marks[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    rng = np.random.default_rng(shortest * 1000 + longest)
    # Within 1.6 steps for each word a walk is seldom at an item's end.
    reach = max(SAMPLED, int(1.6 * shortest))
    steps = np.stack([np.stack([rng.choice(reach, SAMPLED, replace=False) for _ in range(KEYS)]) for _ in range(MOST_WALKS)])
    rate = _rate(words, edits, share, steps, rng)
    walks = 1 if rate >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - rate))) if rate else 0
    if not 0 < walks <= MOST_WALKS:
        none = np.zeros(0, np.uint64)
        return Class_(items, words, shortest, longest, edits, run, least, marks, None, none, np.zeros(0, int))
    steps = steps[: max(walks, 2)]
    text = np.concatenate(words)
    ends = np.cumsum(sizes)
    starts = ends - np.array(sizes)
    keys = np.concatenate([walk(text, starts, ends, i, s) for i, s in enumerate(steps)], axis=1)
    owner = np.repeat(np.arange(len(items)), keys.shape[1])
    order = np.argsort(keys.ravel(), kind="stable")
    return Class_(items, words, shortest, longest, edits, run, least, marks, steps, keys.ravel()[order], owner[order])


def _rate(words: list[np.ndarray], edits: int, share: float, steps: np.ndarray, rng) -> float:
    """How often a walk of an edited copy, from its true begin, has a key of the item: for the quarter of
    some of the items' copies that are found least."""
    hits = []
    for w in words[:: max(1, len(words) // 24)][:24]:
        copy = _edited(w, allowed(len(w), share), rng)
        own = 0
        for i in range(TRIES):
            a = walk(w, np.zeros(1, int), np.array([len(w)]), i, steps[i])
            b = walk(copy, np.zeros(1, int), np.array([len(copy)]), i, steps[i])
            own += bool((a == b).any())
        hits.append(own / TRIES)
    return float(np.quantile(hits, 0.25, method="lower"))


def _runs_of(words: np.ndarray, run: int) -> np.ndarray:
    total = np.zeros(max(len(words) - run + 1, 0), np.uint64)
    for j in range(run):
        total += words[j : len(words) - run + 1 + j] * np.uint64(2 * j + 3) ** np.uint64(5)
    return mixed(total)


def classes(items: list[tuple[int, str]], share: float = EDITS, recall: float = RECALL) -> list[Class_]:
    """Items (id, text) by length in words."""
    held: dict[int, list] = {}
    separators = no_letter_or_digit()
    for run in runs(parted(pa.array([t for _, t in items], pa.string()))):
        begin, end, at = run.words(separators)
        words = run.hashes(begin, end)
        for i in range(run.texts):
            n = at[i + 1] - at[i]
            if n:
                # Items of up to ten words have a class for each length: one edit more matters there.
                size = int(n) if n <= 10 else 10 + int(np.log(n / 10) / np.log(GROWTH))
                held.setdefault(size, []).append((items[run.first + i][0], words[at[i] : at[i + 1]]))
    return [_class(np.array([i for i, _ in x]), [w for _, w in x], share, recall) for _, x in sorted(held.items())]


def edit_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between item and a run of text, and that run's first word and number of words: of those
    with the least edits the one that ends first, and of these the shortest."""
    distance = _last_row(item, text, free_start=True)
    end = int(distance.argmin())
    best = int(distance[end])
    back = _last_row(item[::-1], text[:end][::-1], free_start=False)
    size = int(np.flatnonzero(back == best)[0])
    return best, end - size, size


def _last_row(item: np.ndarray, text: np.ndarray, free_start: bool) -> np.ndarray:
    """Edit distance of item to the texts that end at each place of text."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, int) if free_start else ramp.copy()
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    return row


def _candidates(run: Run, words: np.ndarray, at: np.ndarray, c: Class_) -> dict[tuple[int, int], list[int]]:
    """(text, item) -> window begins, in words of the run, whose keys meet."""
    grams = _runs_of(words, c.run)
    if not len(grams):
        return {}
    bits = len(c.marks).bit_length() - 1
    hit = c.marks[(grams >> np.uint64(64 - bits)).astype(np.int64)]
    total = np.concatenate([[0], np.cumsum(hit)])
    if total[-1] < c.least:
        return {}
    near = np.flatnonzero(hit)
    reach = c.longest + c.edits
    # A window with enough runs begins at most its length before the first of them.
    spread = np.zeros(len(words) + 1, np.int32)
    np.add.at(spread, np.maximum(near - reach, 0), 1)
    np.add.at(spread, np.minimum(near + c.edits + 1, len(words)), -1)
    start = np.flatnonzero(np.cumsum(spread)[:-1] > 0)
    text = np.searchsorted(at, start, "right") - 1
    stop = at[text + 1]
    last = np.minimum(start + reach, stop) - c.run + 1
    last = np.clip(last, 0, len(grams))
    enough = total[np.maximum(last, np.minimum(start, len(grams)))] - total[np.minimum(start, len(grams))] >= c.least
    start, text, stop = start[enough], text[enough], stop[enough]
    if not len(start):
        return {}
    found: dict[tuple[int, int], list[int]] = {}
    if c.steps is None:
        for own in np.split(np.arange(len(start)), np.flatnonzero(np.diff(text)) + 1):
            found.update(((int(text[own[0]]), owner), start[own].tolist()) for owner in range(len(c.items)))
        return found
    for i, steps in enumerate(c.steps):
        keys = walk(words, start, stop, i, steps)
        low, high = np.searchsorted(c.keys, keys, "left"), np.searchsorted(c.keys, keys, "right")
        for s, k in zip(*np.nonzero(high > low)):
            for owner in set(c.owner[low[s, k] : high[s, k]].tolist()):
                found.setdefault((int(text[s]), owner), []).append(int(start[s]))
    return found


def _matches(column: pa.Array, index: list[Class_], share: float) -> Iterator[tuple]:
    """(row, item_id, edits, item_words, first_word, n_words) of an Arrow column of texts."""
    separators = no_letter_or_digit()
    for run in runs(parted(column)):
        begin, end, at = run.words(separators)
        if not len(begin):
            continue
        words = run.hashes(begin, end)
        for c in index:
            for (text, owner), starts in sorted(_candidates(run, words, at, c).items()):
                item = c.words[owner]
                most, a, b = allowed(len(item), share), at[text], at[text + 1]
                best = None
                # Windows that overlap are verified together.
                starts = np.unique(starts)
                edges = np.flatnonzero(np.diff(starts) > len(item) + 2 * most)
                for first, last in zip(starts[np.append(0, edges + 1)], starts[np.append(edges, len(starts) - 1)]):
                    left = max(a, first - most)
                    here = words[left : min(b, last + len(item) + 2 * most)]
                    edits, at_word, size = edit_match(item, here)
                    if edits <= most and (best is None or edits < best[0]):
                        best = (edits, int(left - a) + at_word, size)
                if best:
                    yield run.first + text, int(c.items[owner]), best[0], len(item), best[1], best[2]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about block_bytes, each collected by itself."""
    items = benchmark.select("item_id", "text").where("text is not null and item_id is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = int(total // block_bytes) + 1
    for i in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == i)
        yield [(r.item_id, r.text) for r in block.orderBy("item_id", "text").collect()]


def matches(documents: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL) -> DataFrame:
    """doc_id, item_id, edits, item_words, first_word, n_words for every document and item it holds, at the
    place with the fewest edits."""
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    found = spark.createDataFrame([], MATCH)
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(classes(items, share, recall))

        @giving_back
        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            names = ["item_id", "edits", "item_words", "first_word", "n_words"]
            for batch in batches:
                rows = list(_matches(batch["text"], index.value, share))
                columns = list(zip(*rows)) or [()] * 6
                ids = batch["doc_id"].take(pa.array(columns[0], pa.int64()))
                kinds = [pa.int64(), *[pa.int32()] * 4]
                values = [pa.array(x, k) for x, k in zip(columns[1:], kinds)]
                yield pa.RecordBatch.from_arrays([ids, *values], ["doc_id", *names])

        found = found.unionByName(texts.mapInArrow(search, MATCH))
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The documents that hold no item, with their columns."""
    spark = documents.sparkSession
    for items in blocks(benchmark):
        index = spark.sparkContext.broadcast(classes(items, share, recall))

        @giving_back
        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in _matches(batch["text"], index.value, share)]] = False
                yield batch.filter(pa.array(keep))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
