"""Packing: the bitset against all choices, whole ids back from the pieces, no padding."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tailrace.llm import packing


def nearest(counts, capacity):
    """The largest sum not above the capacity, by trying all choices."""
    choices = itertools.product(*[range(n + 1) for n in counts.values()])
    return max(s for s in (sum(a * b for a, b in zip(counts, c)) for c in choices) if s <= capacity)


@pytest.mark.parametrize("seed", range(60))
def test_closest_fill(seed):
    rnd = random.Random(seed)
    counts = {rnd.randrange(1, 40): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 6))}
    capacity = rnd.randrange(1, 90)
    taken = packing.closest_fill(counts, capacity)
    assert all(n <= counts[length] for length, n in taken.items())
    assert sum(length * n for length, n in taken.items()) == nearest(counts, capacity)


def test_group_fills_windows():
    rnd = random.Random(1)
    group, lengths = packing.Group(64), {i: rnd.choice([0, 1, 5, 33, 40, 63]) for i in range(300)}
    for document, length in lengths.items():
        group.add(document, 0, length)
    sequences = list(group.filled())
    sizes = [sum(p[2] for p in s) for s in sequences]
    assert all(size == 64 for size in sizes[: sum(lengths.values()) // 64])
    assert all(size & (size - 1) == 0 for size in sizes)
    ids = Counter((d, i) for s in sequences for d, start, n in s for i in range(start, start + n))
    assert ids == Counter((d, i) for d, n in lengths.items() for i in range(n))


TEXTS = [
    None,
    "",
    " \n\t ",
    "Hello, World! it's 12 o'clock\x0bnow here there \x1c y",
    "é ́x ΑΣ Σ ﬁ Å <|endoftext|>",
    "same text",
    "same text",
    "a " * 9_000,
    "x" * 30_000,
]


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.mark.parametrize("group_tokens", [1, 500, packing.GROUP_TOKENS])
def test_pieces_hold_every_id_once(spark, group_tokens):
    from tokenizers import Tokenizer

    rnd = random.Random(2)
    texts = TEXTS + [" ".join(rnd.choices(["one", "two,", "Drei", "quatre."], k=rnd.randrange(900))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start", "2 AS ids", "3 AS sequence_id")
    found = packing.pack(docs.repartition(3), vocabulary(), group_tokens=group_tokens).toPandas()
    tokenizer = Tokenizer.from_file(vocabulary())
    for doc_id, own in found.groupby("doc_id"):
        own = own.sort_values("start")
        want = tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids + [2]
        assert np.concatenate([np.frombuffer(b, "<u4") for b in own.ids]).tolist() == want
        assert (own.doc_tokens == len(want)).all() and (own.length > 0).all()
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
    assert found.doc_id.nunique() == len(texts)
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]]
        size = own.length.sum()
        assert size <= 4_096 and size & (size - 1) == 0


def test_null_and_repeated_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    rows = [(None, "one two"), (None, "one two"), (5, "x"), (5, None)]
    found = packing.pack(spark.createDataFrame(rows, schema).coalesce(1), vocabulary()).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in found if not r.start) == Counter({(None, 3): 2, (5, 2): 1, (5, 1): 1})
    assert packing.pack(spark.createDataFrame([], schema), vocabulary()).count() == 0


def test_words_of_any_script_have_the_ids_of_whole_texts(monkeypatch):
    from tokenizers import Tokenizer

    tokenizer, path = Tokenizer.from_file(vocabulary()), packing.Path(vocabulary())
    rnd = random.Random(3)
    odd = ["<|ENDOFTEXT|>", "<|endoftext|>", "H\u0331", "I\u0307", "\u0130", "ΑΣ.", "ﬁ!", "\U0001df00.", "\U0001df00", "\u1c90'", "'S", "it'S"]
    odd += ["Élan,", "ÉLAN", "œuvre...", "Œ", "naïve's", "Straße!", "ẞ?", "\u00a0", "\u0085", "\x1c", "\u2003", "日本。", "日本.", "1.", "x2,", "--"]
    odd += ["".join(chr(rnd.choice([rnd.randrange(33, 0x300), rnd.randrange(33, 0x2FFF)])) for _ in range(3)) for _ in range(400)]
    texts = [None, ""] + [rnd.choice([" ", "\n", "\t \x0b"]).join(rnd.choices(odd, k=rnd.randrange(12))) for _ in range(600)]
    texts += [*odd, "x" * 200 + "! y"]
    encoder = packing.Encoder(path.read_text(encoding="utf-8"), 2)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for held, kind in ((1, pa.string()), (1 << 22, pa.string()), (300, pa.large_string())):
        monkeypatch.setattr(packing, "HELD_BYTES", held)
        whole = pa.array(["before", *texts], kind)
        assert [x.tolist() for x in encoder.ids(whole[1:])] == want


def test_spellings_of_a_word_are_tokenized_once():
    encoder = packing.Encoder(packing.Path(vocabulary()).read_text(encoding="utf-8"), 2)
    list(encoder.ids(pa.array(["Élan élan, ÉLAN! élan... Straße", "STRASSE, straße? élan"])))
    assert {word for word in encoder.known if word.isalpha()} == {"élan", "straße", "strasse"}
    assert set(encoder.known) <= {"élan", "straße", "strasse", "", ",", "!", "...", "?"}
