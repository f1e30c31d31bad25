"""Packing documents into token sequences of a fixed window, by minimum bin slack.

A task tokenizes its documents and packs them in groups of about GROUP_TOKENS tokens, so nothing is shuffled, no plan
passes through the driver, and memory is bounded by a group and the longest document. A document's full windows are
sequences by themselves. What remains of each document, 0 to WINDOW - 1 tokens, is a multiset of lengths. Every further
window starts with the longest remaining piece; a bitset of reachable sums (one shift and one union for each length and
power of two of its count) finds the multiset of lengths that fills the window closest to capacity, and going back through
the bitsets gives how many of each length to take. Slack that no multiset fills takes a cut of the next piece. The end of a
group, shorter than a window, goes to sequences whose lengths are powers of two, which need no padding. So no id is padded
at all, and few documents are cut in other places than full windows.

A word between white space is tokenized once by a worker, as tokens never cross white space in the
vocabularies this is for (pre-tokenizers that split at it and drop it). Texts are split, their different words told apart
and their ids put back as Arrow arrays, a few MB of text at a time; Python meets each different word of those once.
Letters and the punctuation behind them are words by themselves. New words of letters alone are tokenized many at a time
as one text, which is cut where tokens end words; that as many end as there are words proves the cuts. Where the
vocabulary is of lower case, texts are lowered before, but for those in which that might change an id. The vocabulary is
read in the driver (a few MB) and broadcast. A very long text is looked up alone and takes memory in proportion to its
words and ids.

A null text is empty: it has the end id alone. Ties and repeated rows are documents of their own. An empty table gives
no rows. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import string
import sys
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterable, Iterator, Mapping
from pathlib import Path
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 4_096
END_ID = 2
GROUP_TOKENS = 1 << 22
# Words whose ids a worker holds; the table starts anew beyond that. Longer words are never held.
HELD_WORDS, HELD_LENGTH = 1 << 20, 64
HELD_BYTES = 1 << 22  # of texts that are looked up together; a longer text is looked up alone
# Of characters below U+0300 but I with a dot, lower case is one of each and normal forms are the same.
MARKED = "[\u0130\u0300-\U0010ffff]"
BATCH_WORDS = 1 << 12  # words sent to the tokenizer at once
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SEQUENCE_BITS = 36  # of a task's sequence numbers, below the task's own


# Bitsets --------------------------------------------------------------------------------------------


def closest_fill(counts: Mapping[int, int], capacity: int, lengths: Iterable[int] | None = None) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to the capacity as can be, not above.
    counts: how many there are of each length; lengths: those to try, in that order (default: from the longest)."""
    mask = (1 << (capacity + 1)) - 1
    reach, before = 1, []
    for length in sorted(counts, reverse=True) if lengths is None else lengths:
        if length > capacity:
            continue
        before.append((length, reach))
        left, power = min(counts[length], capacity // length), 1
        while left:
            step = min(power, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            power *= 2
        if reach >> capacity:
            break
    rest, taken = reach.bit_length() - 1, {}
    for length, reached in reversed(before):
        n = 0
        while not reached >> (rest - n * length) & 1:
            n += 1
        if n:
            taken[length] = n
            rest -= n * length
    return taken


class Group:
    """The remaining pieces of some documents, by length; filled() empties it into windows."""

    def __init__(self, window: int):
        self.window = window
        self.pieces: dict[int, list[tuple]] = {}  # length -> (document, start)
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []  # in order
        self.total = 0

    def add(self, document: object, start: int, length: int) -> None:
        if not length:
            return
        if not self.counts.get(length):
            insort(self.lengths, length)
        self.pieces.setdefault(length, []).append((document, start))
        self.counts[length] = self.counts.get(length, 0) + 1
        self.total += length

    def _take(self, length: int) -> tuple:
        piece = self.pieces[length].pop()
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.lengths[bisect_left(self.lengths, length)]
        self.total -= length
        return (*piece, length)

    def _filled(self, capacity: int) -> list[tuple]:
        """Pieces of exactly this capacity in all; there must be enough."""
        found, rest = [], capacity
        fits = bisect_right(self.lengths, capacity)
        if fits:
            found.append(self._take(self.lengths[fits - 1]))
            rest -= found[0][2]
        lengths = (self.lengths[i] for i in range(bisect_right(self.lengths, rest) - 1, -1, -1))
        for length, n in closest_fill(self.counts, rest, lengths).items():
            found += [self._take(length) for _ in range(n)]
            rest -= length * n
        while rest:  # no piece that is left fits whole together with these
            document, start, length = self._take(self.lengths[-1])
            cut = min(rest, length)
            found.append((document, start, cut))
            self.add(document, start + cut, length - cut)
            rest -= cut
        return found

    def filled(self) -> Iterator[list[tuple]]:
        """Sequences as lists of (document, start, length): full windows, then powers of two."""
        while self.total:
            yield self._filled(min(self.window, 1 << (self.total.bit_length() - 1)))


# Tasks ----------------------------------------------------------------------------------------------


def _behind(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What follows each stem in its word."""
    whole, kept = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (words, stems))
    sizes = whole - kept
    ends = np.cumsum(sizes)
    at = np.arange(sizes.sum()) + np.repeat(np.cumsum(whole) - ends, sizes)
    bare = words.cast(pa.large_binary())
    _, places, data = bare.buffers()
    data = np.frombuffer(data or b"", np.uint8)[np.frombuffer(places, np.int64)[bare.offset] :][at]
    return pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(data))


class Encoder:
    """Token ids of whole texts, each different word encoded once."""

    def __init__(self, vocabulary: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_str(vocabulary), end_id
        self.known: dict[str, bytes] = {}
        self.ends = None
        rules = json.loads(vocabulary)
        self.lower = "Lowercase" in json.dumps(rules["normalizer"])
        self.added = [x["content"] for x in rules.get("added_tokens") or []]
        self.letters: dict[str, bool] = {}
        suffix = rules["model"].get("end_of_word_suffix")
        if suffix:
            words = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(words.values()) + 1, bool)
            self.ends[[i for word, i in words.items() if word.endswith(suffix)]] = True

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text and the end id."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < len(texts):
            most = HELD_BYTES + (ends[first - 1] if first else 0)
            last = max(first + 1, int(np.searchsorted(ends, most, "right")))
            yield from self._looked_up(texts[first:last])
            first = last

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """Texts in lower case where that changes no id: without added tokens, which are found before, and characters
        of MARKED."""
        if not self.lower:
            return texts
        lowered = pc.utf8_lower(texts)
        other = pc.match_substring_regex(texts, MARKED)
        for token in self.added:
            other = pc.or_(other, pc.match_substring(lowered, token.lower()))
        return pc.if_else(other, texts, lowered)

    def _looked_up(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if len(self.known) > HELD_WORDS:
            self.known = {}
        words = pc.ascii_split_whitespace(self._lowered(texts.fill_null("")))
        edges, coded = words.offsets.to_numpy(), words.flatten().dictionary_encode()
        found = self._of_words(coded.dictionary).take(coded.indices)
        _, places, data = found.buffers()
        cuts = np.frombuffer(places, np.int64)[edges] // 4
        ids, end = np.frombuffer(data or b"", np.uint32), np.array([self.end_id], np.uint32)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            yield np.append(ids[a:b], end)

    def _of_words(self, words: pa.Array) -> pa.Array:
        """Ids of different words, as bytes; letters and the punctuation behind them one by one."""
        if self.ends is None:
            return self._held(words)
        stems = pc.ascii_rtrim(words, characters=string.punctuation)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        parted = pa.array([self._parted(c) for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        stems = pc.if_else(pc.and_(pc.utf8_is_alpha(stems), parted), stems, words)
        return pc.binary_join_element_wise(self._held(stems), self._held(_behind(words, stems)), pa.scalar(b"", pa.large_binary()))

    def _parted(self, letter: str) -> bool:
        """Whether the vocabulary parts this letter from punctuation behind it."""
        if letter not in self.letters:
            both, own, mark = self.tokenizer.encode_batch_fast([letter + "!", letter, "!"], add_special_tokens=False)
            self.letters[letter] = both.ids == own.ids + mark.ids
        return self.letters[letter]

    def _held(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = {word for word in names if word not in self.known}
        self._learn(new)
        found = pa.array([self.known[word] for word in names], pa.large_binary()).take(coded.indices)
        for word in new:
            if len(word) > HELD_LENGTH:
                del self.known[word]
        return found

    def _learn(self, words: set[str]) -> None:
        if self.ends is None:
            self._one_by_one(list(words))
            return
        letters = set(filter(str.isalpha, words))
        self._one_by_one(list(words.difference(letters)))
        fresh = list(letters)
        for i in range(0, len(fresh), BATCH_WORDS):
            part = fresh[i : i + BATCH_WORDS]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
                self.known.update(zip(part, [data[a:b] for a, b in zip(at, at[1:])]))
            else:  # a letter that is none for the vocabulary
                self._one_by_one(part)

    def _one_by_one(self, words: list[str]) -> None:
        for i in range(0, len(words), BATCH_WORDS):
            part = words[i : i + BATCH_WORDS]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[word] = array("I", found.ids).tobytes()


def shared_encoder(vocabulary: str, end_id: int) -> Encoder:
    """The encoder of a Python worker, with the words that its tasks have seen. This module travels with each task
    and goes with it, so the encoder is held by a module of the worker's own."""
    held = sys.modules.setdefault("tailrace_held", ModuleType("tailrace_held"))
    key = (hash(vocabulary), end_id)
    if getattr(held, "key", None) != key:
        held.key, held.encoder = key, Encoder(vocabulary, end_id)
    return held.encoder


def _packed(encoder: Callable[[], Encoder], window: int, group_tokens: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = encoder()
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << SEQUENCE_BITS
        group, rows, held = Group(window), [], 0

        def put(pieces: list[tuple]) -> None:
            nonlocal sequence, held
            offset = 0
            for (doc_id, ids, first, tokens), start, length in pieces:
                data = ids[start - first : start - first + length].tobytes()
                rows.append((doc_id, start, length, data, tokens, sequence, offset))
                offset += length
            sequence += 1
            held += offset

        def batch() -> pa.RecordBatch:
            nonlocal held
            types = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECE.split(", ")]
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), types)]
            rows.clear()
            held = 0
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in PIECE.split(", ")])

        for found in batches:
            for doc_id, ids in zip(found["doc_id"].to_pylist(), texts.ids(found["text"])):
                whole = len(ids) - len(ids) % window
                for start in range(0, whole, window):
                    put([((doc_id, ids, 0, len(ids)), start, window)])
                    if held >= group_tokens:
                        yield batch()
                # A copy, as a view would hold the whole document.
                group.add((doc_id, ids[whole:].copy(), whole, len(ids)), whole, len(ids) - whole)
                if group.total >= group_tokens:
                    for pieces in group.filled():
                        put(pieces)
                    yield batch()
        for pieces in group.filled():
            put(pieces)
        if rows:
            yield batch()

    return pack


def pack(
    documents: DataFrame,
    vocabulary: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start (the document's ids before it), length, ids (unsigned 32-bit, little-endian),
    doc_tokens (end id included), sequence_id, and offset, the piece's place in its sequence. Every id lies in one piece;
    a sequence's pieces follow one another from offset 0. vocabulary: path of a tokenizer file, read in the driver."""
    text = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    encoder = lambda: shared_encoder(text.value, end_id)
    rows = documents.selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return rows.mapInArrow(_packed(encoder, window, group_tokens), PIECE)
