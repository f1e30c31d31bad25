"""The operators against brute force on small tables, with nulls, empty and repeated rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tailrace.llm import (
    bytewise,
    chunks,
    components,
    decontamination,
    grouping,
    hilbert,
    jaccard,
    metric,
    mixture,
    revisits,
    substrings,
    toxicity,
)
from tailrace.llm.queries import QUERIES
from tailrace.plans.tables import Tables

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=3):
    """Rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENT).repartition(parts)


# Helpers ------------------------------------------------------------------------------------


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["  One two\tTHREE ", None, "", "x", "é ü\none two three four five"]
    (run,) = bytewise.runs(pa.array(texts))
    begin, end, at = run.words(bytewise.white_space())
    words = [[run.bytes[b:e].tobytes().decode() for b, e in zip(begin[i:j], end[i:j])] for i, j in zip(at, at[1:])]
    assert words == [(t or "").split() for t in texts]
    hashes = run.hashes(begin, end, fold=True)
    assert hashes[0] == hashes[6] and hashes[2] == hashes[8] and len(set(hashes.tolist())) == 8
    text, value = bytewise.shingles(hashes, at, 5)
    assert collections.Counter(text.tolist()) == {0: 1, 3: 1, 4: 3}
    # Texts in runs of a few bytes give the same.
    many = [run.hashes(*run.words(bytewise.white_space())[:2], fold=True) for run in bytewise.runs(pa.array(texts), 4)]
    assert np.concatenate(many).tolist() == hashes.tolist()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    frame = spark.createDataFrame(edges + [(None, 5), (7, 7)], "a long, b long").repartition(4)
    found = components.components(frame, Tables(spark)).collect()
    label = {i: i for i in range(400)}
    for _ in range(100):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in found} == {i: c for i, c in label.items() if i != c}


def test_no_edges(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert components.components(empty, Tables(spark)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_suffix_arrays(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 30, rng.integers(1, 6))
    at = np.concatenate([[0], np.cumsum(sizes)])
    symbols = rng.integers(1, rng.integers(2, 6), at[-1])
    want = [a + i for a, b in zip(at, at[1:]) for i in sorted(range(b - a), key=lambda i: tuple(symbols[a + i : b]))]
    assert grouping.suffix_arrays(symbols, at).tolist() == want


# 1 ------------------------------------------------------------------------------------------


def linked(rows):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    label = list(range(len(rows)))
    pairs = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    for _ in rows:
        before = list(label)
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    first = {}
    for i, c in enumerate(label):
        first[c] = min(first.get(c, rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), first[c]) for i, c in enumerate(label))


@pytest.mark.parametrize("heavy", [None, 12])
def test_jaccard_join(spark, heavy, monkeypatch):
    if heavy:
        monkeypatch.setattr(jaccard, "boundary", lambda sizes, tasks: heavy)
    rnd = random.Random(heavy or 1)
    base = [[f"w{rnd.randrange(30)}" for _ in range(n)] for n in (0, 1, 3, 5, 8, 9, 10, 11, 13, 16, 40, 90) * 2]
    rows = []
    for i in range(250):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if words:
                at = rnd.randrange(len(words))
                words[at : at + rnd.randrange(2)] = rnd.choice([["X"], [], words[at : at + 1] * 2])
        rows.append((i * 7 % 250, rnd.choice(["  ", "\n"]).join(words) if i % 40 else None))
    found = jaccard.near_copies(documents(spark, rows, 4))
    assert sorted(map(tuple, found.collect())) == linked(rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard.near_copies(documents(spark, [])).count() == 0
    same = [(4, "a b c"), (4, "a b c"), (None, "a b c"), (9, None), (None, "z")]
    found = jaccard.near_copies(documents(spark, same).withColumnRenamed("lang", "set_id"))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(
        [(4, 1, 4), (4, 1, 4), (None, 1, 4), (9, 0, 9), (None, 1, None)]
    )


def test_boundary_follows_cost():
    assert jaccard.boundary([(6, 100, 0), (9, 100, 0)], 4) == 3
    assert jaccard.boundary([(6, 100, 5_000), (9, 100, 0)], 4) == 7


# 2 ------------------------------------------------------------------------------------------


def test_decontamination(spark):
    rnd = random.Random(5)
    voc = [f"v{i}" for i in range(400)]
    items = [(i, [rnd.choice(voc) for _ in range(n)]) for i, n in enumerate([3, 4, 7, 12, 15, 20, 33, 50, 60] * 3)]
    rows, want = [], set()
    for i, words in items:
        edited = list(words)
        for _ in range(int(len(words) * 0.15)):
            edited[rnd.randrange(len(edited))] = "other"
        for k, inside in enumerate((words, edited, words[: len(words) // 2])):
            padded = [rnd.choice(voc) for _ in range(30)] + inside + [rnd.choice(voc) for _ in range(30)]
            rows.append((i * 3 + k, " ".join(padded).upper() if k == 0 else ", ".join(padded)))
            if k < 2:
                want.add((i * 3 + k, i))
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (None, rows[0][1])]
    benchmark = spark.createDataFrame(
        [*((i, " ".join(w)) for i, w in items), (90, None), (91, "!?"), (92, " ".join(items[0][1]))], "item_id long, text string"
    )
    frame = documents(spark, rows)
    found = decontamination.matches(frame, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found if r.item_id < 90}
    assert {(0, 0), (1002, 0), (None, 0)} <= got and (0, 92) in {(r.doc_id, r.item_id) for r in found}
    assert len(want - got) <= 1
    for r in found:  # every match is within its edits, at the place it names
        assert r.edits <= r.item_words // 5
    whole = next(r for r in found if (r.doc_id, r.item_id) == (24, 8))
    assert (whole.edits, whole.first_word, whole.n_words) == (0, 30, 60)
    kept = {r.doc_id for r in decontamination.decontaminate(frame, benchmark).collect()}
    assert kept == {d for d, *_ in rows} - {d for d, _ in got} - {r.doc_id for r in found}
    assert decontamination.matches(documents(spark, []), benchmark).count() == 0
    assert decontamination.decontaminate(frame, benchmark.limit(0)).count() == len(rows)


def test_decontamination_of_any_script(spark):
    """Words are parted by spaces, dashes and quotes of any script; where a script has none, each character is a word."""
    han = "".join(chr(0x4E00 + 37 * i) for i in range(30))
    rows = [
        (0, "before\u00a0“one two three four five six”—after", None),
        (1, "字" * 9 + han + "字" * 9, None),
        (2, "字" * 9 + han[:14] + "x" + han[14:] + "字" * 9, None),
        (3, "onetwo three four five six", None),
        (4, "字" * 40, None),
    ]
    frame = documents(spark, [r[:2] for r in rows]).selectExpr("*", "1 AS item_id", "2 AS edits", "3 AS first_word")
    benchmark = spark.createDataFrame([(0, "One two, three four five six."), (1, han)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.edits, r.first_word, r.n_words) for r in decontamination.matches(frame, benchmark).collect()}
    assert found == {(0, 0): (0, 1, 6), (1, 1): (0, 9, 30), (2, 1): (1, 9, 31)}
    kept = decontamination.decontaminate(frame, benchmark)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_items_that_walks_do_not_find_are_verified_without_keys(spark, monkeypatch):
    rnd = random.Random(6)
    voc = [f"v{i}" for i in range(300)]
    items = [(i, [rnd.choice(voc) for _ in range(n)]) for i, n in enumerate([5, 9, 25, 80, 200])]
    rows = []
    for i, words in items:
        edited = [w if j % 5 else "other" for j, w in enumerate(words[: len(words) // 5 * 5])] + words[len(words) // 5 * 5 :]
        rows.append((i, " ".join([rnd.choice(voc) for _ in range(50)] + edited + [rnd.choice(voc) for _ in range(50)])))
    rows.append((50, " ".join(rnd.choice(voc) for _ in range(900))))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    monkeypatch.setattr(decontamination, "_rate", lambda *_: 0.0)
    assert all(c.steps is None for c in decontamination.classes([(i, " ".join(w)) for i, w in items]))
    found = {(r.doc_id, r.item_id) for r in decontamination.matches(documents(spark, rows), benchmark).collect()}
    assert found == {(i, i) for i, _ in items}


def test_edit_match():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    for _ in range(60):
        item, text = rng.integers(0, 3, rng.integers(1, 8)), rng.integers(0, 3, rng.integers(1, 15))
        edits, first, size = decontamination.edit_match(item, text)
        every = {(i, j): distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
        assert edits == min(every.values()) == every[first, first + size]


# 3 ------------------------------------------------------------------------------------------


def test_severity_grows_with_the_words(spark):
    rnd = random.Random(3)
    clean, bad = [f"w{i}" for i in range(60)], ["scum", "idiot", "moron", "trash", "loser", "clown"]
    rows, labels = [], []
    for i in range(600):
        words = rnd.sample(clean, 20)
        toxic = i % 4 == 0
        words += rnd.sample(bad, rnd.randint(1, 5)) if toxic else []
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(0, None), (None, 1)]
    frame = documents(spark, rows)
    model = toxicity.train(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    probes = [(0, " ".join(clean[:20])), (1, "SCUM! w1"), (2, "scum, idiot, moron, trash, loser"), (3, None), (4, ""), (4, "")]
    scored = {r.doc_id: r for r in toxicity.score(documents(spark, probes).withColumnRenamed("lang", "toxic"), model).collect()}
    assert [scored[i].toxic for i in range(5)] == [False, True, True, False, False]
    assert scored[0].severity < scored[1].severity < scored[2].severity <= 3
    assert scored[2].severity_grade > scored[0].severity_grade == 0
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_model_without_labels(spark):
    model = toxicity.train(documents(spark, [(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.toxic for r in toxicity.score(documents(spark, [(1, "a")]), model).collect()] == [False]


# 4 ------------------------------------------------------------------------------------------


def test_curve_visits_neighbours(spark):
    points = [(x, y, z) for x in range(8) for y in range(8) for z in range(8)]
    frame = hilbert.with_curve(spark.createDataFrame(points, "x int, y int, z int"), ["x", "y", "z"], 3)
    path = [r[:3] for r in sorted(frame.collect(), key=lambda r: r.curve)]
    assert sorted(r.curve for r in frame.collect()) == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a, b)) == 1 for a, b in zip(path, path[1:]))


def test_shards_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 4)
    rows = [(i, "x" * (i * i), f"s{i % 3}") for i in range(70)] + [(None, None, None), (3, "x" * 9, "s0"), (3, "x" * 9, "s0")]
    found = hilbert.shard_documents(documents(spark, rows).withColumnRenamed("n_chars", "slot")).collect()
    sizes = collections.Counter(r.shard for r in found)
    assert len(found) == 73 and max(sizes.values()) - min(sizes.values()) <= 1
    assert sorted((r.shard, r.slot) for r in found) == [(s, i) for s in range(16) for i in range(sizes[s])]
    assert hilbert.shard_documents(documents(spark, [])).count() == 0
    few = hilbert.shard_documents(documents(spark, rows[:3])).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_shards(spark, tmp_path):
    rows = [(i, "x" * i, f"s{i % 5}") for i in range(200)]
    manifest = hilbert.write_shards(documents(spark, rows), f"{tmp_path}/out", shards=4).collect()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == 200 and sorted(r.n_rows for r in manifest) == [50] * 4
    assert {r.doc_id: r.text for r in back.collect()} == {i: t for i, t, _ in rows}


def test_written_shards_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows and clashing columns: every row is written once."""
    rows = [(None if i % 10 == 0 else i % 50, f"text {i % 30}" if i % 7 else None) for i in range(200)]
    frame = documents(spark, rows).selectExpr("*", "99 AS shard", "98 AS slot", "97 AS curve", "96 AS size")
    manifest = hilbert.write_shards(frame, f"{tmp_path}/out", shards=4).collect()
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.n_rows for r in manifest) == [50] * 4
    assert back.groupBy("shard").count().collect() and {r["count"] for r in back.groupBy("shard").count().collect()} == {50}
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=key) == sorted(rows, key=key)
    assert {(r.shard_of_document, r.slot, r.curve, r.size) for r in back.collect()} == {(99, 98, 97, 96)}


# 5 ------------------------------------------------------------------------------------------


def test_metric_join(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 8))
    vectors = [list(map(float, centers[i % 12] + rng.normal(size=8) * 0.25)) for i in range(300)]
    rows = [(i * 3 % 300, v) for i, v in enumerate(vectors) if i % 100]
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    rows += [(400, rows[5][1]), (401, [2 * x for x in rows[5][1]]), (402, [0.0] * 8), (403, None), (404, []), (405, [1.0, None] * 4)]
    rows += [(406, [float("nan")] * 8), (407, [1.0, 0.0, 0.0]), (408, [1.0, 0.01, 0.0]), (409, [float("inf")] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = {r.vec_id: r.embedding for r in frame.collect()}
    unit = {}
    for i, v in exact.items():
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    pairs = {i: {j for j in unit if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9} for i in unit}
    label = {i: i for i in exact}
    for _ in range(40):
        for i, others in pairs.items():
            label[i] = min([label[i], *(label[j] for j in others)])
    want = sorted((i, len(pairs.get(i, ())), label[i], label[i] == i) for i in exact)
    for block in (40, 4096):
        found = metric.near_duplicates(frame.withColumn("label", frame["vec_id"]), block=block)
        assert sorted(map(tuple, found.collect())) == want
    assert metric.near_duplicates(frame.limit(0)).count() == 0


def test_metric_join_writes_no_copies(spark, monkeypatch):
    """Vectors that pivots cannot part are not copied for the cells that they might meet."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(1_200, 24))
    vectors[600:900] = vectors[:300] + rng.normal(size=(300, 24)) * 0.1
    vectors = vectors.astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    written = {}

    class Counted(Tables):
        def write(self, df, name):
            table = super().write(df, name)
            written[name] = max(written.get(name, 0), table.count())
            return table

    monkeypatch.setattr(metric, "Tables", Counted)
    found = {r.vec_id: r for r in metric.near_duplicates(frame.repartition(2), block=50).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    assert [found[i].n_links for i in range(1_200)] == (linked.sum(1) - 1).tolist()
    assert found[0].component_id == found[600].component_id == 0
    assert max(written.values()) < 3 * len(vectors)


@pytest.mark.parametrize("dims, kind", [(24, np.float32), (64, np.float64), (5, np.float64)])
def test_cosines_by_blocks(dims, kind):
    """Pairs found along leading axes, whole or at the very limit are those of double precision."""
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(400, dims)).astype(kind)
    x[200:300] = x[:100] + rng.normal(size=(100, dims)) * 0.05
    x[300:] = x[0] + rng.normal(size=(100, dims)) * 0.01
    x = metric._unit(x)
    axes = metric._axes(x[:200], 0.9)
    assert (axes is not None) == (dims > 5)
    cosines = (x[:, None] * x).sum(2)
    for limit in (0.9, float(cosines[0, 200]), float(cosines[3, 7])):
        for own in (None, axes):
            found = [np.stack(part, 1) for part in metric._hits(x, x, own, limit)]
            assert set(map(tuple, np.concatenate(found).tolist())) == set(zip(*(i.tolist() for i in np.nonzero(cosines >= limit))))


def test_equal_vectors_of_any_key(spark):
    """Keys of text, null and repeated keys; zeros of either sign are equal, and equal vectors count as one that weighs."""
    rows = [("b", [1.0, 0.0]), ("a", [1.0, -0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), ("c", [0.0, -1.0]), ("c", [-0.0, -2.0])]
    frame = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(4)
    found = sorted(map(str, map(tuple, metric.near_duplicates(frame).collect())))
    want = [("b", 2, "a", False), ("a", 2, "a", True), (None, 2, "a", False), (None, 0, None, False), *[("c", 1, "c", True)] * 2]
    assert found == sorted(map(str, want))


# 7 ------------------------------------------------------------------------------------------

RECORD = "record_id long, url string, captured long, kind string, etag string, last_modified string, headers map<string,string>, digest string"


def test_revisits(spark, monkeypatch):
    response = {"content-length": "10", "etag": '"a"', "date": "d1"}
    rows = [
        (1, "http://WWW.x.org:80/p/?b=2&a=1&utm_source=z#f", 10, "response", '"a"', "m1", response, "D1"),
        (2, "https://x.org/p?a=1&b=2", 20, "response", '"b"', "m2", {"date": "d2"}, "D2"),
        (12, "https://x.org/p?a=1&b=2", 20, "response", '"c"', "m2", None, "D3"),
        (3, "x.org/p", 5, "response", '"a"', "m1", response, "D4"),
        (4, "http://x.org/p?b=2&a=1", 15, "revisit", 'W/"a"', None, {"content-length": "0", "date": "d9", "age": "3"}, None),
        (5, "http://x.org/p?b=2&a=1", 10, "revisit", '"a"', None, {}, None),
        (6, "http://x.org/p?b=2&a=1", 30, "revisit", '"b"', None, {}, None),
        (7, "http://x.org/p?b=2&a=1", 30, "revisit", None, "m2", None, None),
        (8, "http://x.org/p?b=2&a=1", 30, "revisit", None, None, {}, None),
        (9, None, 30, "revisit", '"a"', None, {}, None),
        (10, "http://x.org/p?b=2&a=1", None, "revisit", '"a"', None, {}, None),
        (11, "http://x.org/p?b=2&a=1", 30, "metadata", '"a"', None, {}, None),
        (4, "http://x.org/p?b=2&a=1", 15, "revisit", 'W/"a"', None, {"content-length": "0", "date": "d9", "age": "3"}, None),
    ]
    records = spark.createDataFrame(rows, RECORD).repartition(3)
    found = sorted(revisits.resolve(records).collect(), key=lambda r: r.record_id)
    assert [(r.record_id, r.response_id, r.outcome, r.digest) for r in found] == [
        (4, 1, "resolved", "D1"),
        (4, 1, "resolved", "D1"),
        (5, None, "no_earlier_response", None),
        (6, 12, "validator_mismatch", None),
        (7, 12, "resolved", "D3"),
        (8, 12, "no_validator", None),
        (9, None, "no_earlier_response", None),
        (10, None, "no_earlier_response", None),
    ]
    assert found[0].headers == {"content-length": "10", "etag": '"a"', "date": "d9", "age": "3"}
    assert found[0].canonical_url == "x.org/p?a=1&b=2"
    assert revisits.resolve(records.limit(0)).count() == 0


def test_hot_url_as_of(spark):
    rnd = random.Random(8)
    rows = [
        (i, "http://h/" if rnd.random() < 0.7 else f"http://o{i % 5}/", rnd.randrange(1000), rnd.choice(["response", "revisit"]), '"e"', None, {}, str(i))
        for i in range(600)
    ]
    found = revisits.resolve(spark.createDataFrame(rows, RECORD).repartition(4)).collect()
    for r in found:
        own = next(x for x in rows if x[0] == r.record_id)
        before = [(x[2], x[0]) for x in rows if x[3] == "response" and x[1] == own[1] and x[2] < own[2]]
        assert r.response_id == (max(before)[1] if before else None)


# 8 ------------------------------------------------------------------------------------------


def test_line_chunks(spark):
    rnd = random.Random(6)
    shared = [f"shared line {i} {rnd.random()}" for i in range(40)]
    rows = []
    for i in range(30):
        own = [f"own {i} {j}" for j in range(rnd.randrange(12))]
        rows.append((i, "\n".join(own[:3] + shared[(i % 3) * 5 :] + own[3:]) + ("\n" if i % 2 else "")))
    rows += [(100, None), (101, ""), (102, "\n\n\n\n\n\n"), (103, "\n\n\n\n\n\n"), (104, rows[0][1]), (104, rows[0][1])]
    found = chunks.remove_repeats(documents(spark, rows).withColumnRenamed("n_chars", "n_lines")).collect()
    text = {r.doc_id: r.text for r in found}
    assert len(found) == len(rows) and text[100] is None and text[101] == "" and text[102] == text[103] == rows[32][1]
    assert text[0] == rows[0][1]  # the first stays whole
    kept = collections.Counter(line for r in found if r.doc_id < 100 for line in r.text.split("\n") if line.startswith("shared"))
    whole = collections.Counter(line for _, t in rows[:30] for line in t.split("\n") if line.startswith("shared"))
    assert sum(kept.values()) < 0.35 * sum(whole.values()) and set(kept) == set(whole)
    for doc_id, before in rows[:30]:  # own lines stay, in their order
        assert [x for x in before.split("\n") if x.startswith("own")] == [x for x in text[doc_id].split("\n") if x.startswith("own")] or doc_id > 0
    for r in found:
        before = dict(rows)[r.doc_id] or ""
        assert r.n_removed_bytes == len(before.encode()) - len((r.text or "").encode())
    assert chunks.remove_repeats(documents(spark, [])).count() == 0


def without_repeats(rows):
    """By row, the text without lines that lie in a later chunk (two neighbouring lines) and in no first one."""
    found = {}
    for doc_id, text in sorted(rows):
        split = text.splitlines(keepends=True)
        full = [i for i, line in enumerate(split) if line.strip()]
        for first, last in zip(full, full[1:]):
            chunk = "".join(split[first : last + 1]).removesuffix("\n")
            found.setdefault(chunk, []).append((doc_id, first, last))
    gone, whole = set(), set()
    for places in found.values():
        for turn, (doc_id, first, last) in enumerate(places if len(places) > 1 else []):
            (gone if turn else whole).update((doc_id, i) for i in range(first, last + 1))
    return {
        doc_id: "".join(x for i, x in enumerate(text.splitlines(keepends=True)) if (doc_id, i) not in gone - whole)
        for doc_id, text in rows
    }


def test_line_chunks_of_short_passages(spark):
    rnd = random.Random(11)
    rows, n = [], 0
    for lines in range(2, 7):
        for k in range(20):
            passage = [f"passage {lines} {k} {i}" for i in range(lines)]
            for _ in range(2):
                own = [f"own {n} {i}" for i in range(rnd.randrange(1, 6))]
                at = rnd.randrange(len(own) + 1)
                rows.append((n, "\n".join(own[:at] + passage + own[at:])))
                n += 1
    found = {r.doc_id: r for r in chunks.remove_repeats(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        own = [x for x in text.split("\n") if x.startswith("own")]
        if doc_id % 2:
            assert found[doc_id].text.split("\n")[: len(own)] == own and "passage" not in found[doc_id].text
        else:
            assert found[doc_id].text == text and found[doc_id].n_removed_lines == 0


def test_line_chunks_against_brute_force(spark):
    rnd = random.Random(12)
    rows = [(i, "\n".join(rnd.choice(["", " ", *"abcdefgh"]) for _ in range(rnd.randrange(1, 9)))) for i in range(80)]
    found = chunks.remove_repeats(documents(spark, rows)).collect()
    assert {r.doc_id: r.text for r in found} == without_repeats(rows)


# 9 ------------------------------------------------------------------------------------------


def test_mixture_meets_targets(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.randrange(60)), f"s{min(i % 7, 3)}" if i % 50 else None) for i in range(900)]
    rows += [(2000, None, "s0"), (2001, "", "lonely"), (2002, "w w", "s0"), (2002, "w w", "s0")]
    frame = documents(spark, rows, 4)
    found = mixture.mix_documents(frame).collect()
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in rows)
    by = collections.defaultdict(list)
    source = {r[0]: r[2] for r in rows}
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        by[source[r.doc_id]].append(r)
    total = sum(r.size for r in found)
    assert sum(own[0].target for own in by.values()) == pytest.approx(total)
    for own in by.values():
        assert own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= 3
    assert sorted(map(tuple, mixture.mix_documents(frame.repartition(2)).collect())) == sorted(map(tuple, found))
    assert mixture.mix_documents(documents(spark, [])).count() == 0


def test_mixture_with_a_very_long_document(spark):
    digest = lambda i, size: hashlib.md5(f"0:{i}:{size}:".encode()).hexdigest()
    first = min(range(201), key=lambda i: digest(i, 4000))
    assert digest(first, 4000) < min(digest(i, 20) for i in range(201) if i != first)
    rows = [(i, ["b"], 4000 if i == first else 20) for i in range(201)]
    rnd = random.Random(2)
    long = [(1000 + i, ["c"], int(4 ** (8 * rnd.random()))) for i in range(400)]
    rows += [(500, ["a"], 5650), *long]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, size long").repartition(3)
    for own in ({"a", "b"}, {"a", "b", "c"}):
        found = mixture.mix(frame.where(frame["members"][0].isin(*own)), "members", "size").collect()
        for source in own:
            mine = [r for r in found if r.members == [source]]
            quota = round(mine[0].target)
            copies, rest = divmod(quota, mine[0].source_size)
            left = quota - sum(r.taken for r in mine)
            assert left >= 0 and rest >= left
            assert all(r.taken > copies * r.size or r.size > left for r in mine if r.size)
            assert source != "b" or left < 20


def test_mixture_equals_sql_where_many_turns_are_needed(spark):
    """Sizes of all magnitudes, null and repeated ids, repeated rows; the same rule in SQL."""
    import duckdb

    from tailrace.llm.oracle import ORACLES

    rnd = random.Random(11)
    rows = [(rnd.choice([None, 7, i]), "w " * int(4 ** (6 * rnd.random())) + str(i % 40), f"s{i % 3}") for i in range(400)]
    rows += [(None, None, None), (1, "", "s1"), (2, "x y", None), (2, "x y", None), (3, "z", "alone")]
    frame = documents(spark, rows, 4)
    con = duckdb.connect()
    con.register("documents", frame.toArrow())
    found = mixture.mix_documents(frame)
    sql = con.sql(ORACLES["op9_mixture"])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.select(*sql.columns).collect()), key=key) == sorted(sql.fetchall(), key=key)
    turns = con.sql(ORACLES["op9_mixture"].split("SELECT doc_id, size, source_size, target, CAST")[0] + "SELECT max(turn) FROM turns")
    assert turns.fetchall()[0][0] >= 3


def test_flow_through_overlapping_sources(spark):
    # All of both sources' words are in documents that belong to both, but for ten of a's.
    rows = [(i, ["a", "b"], 10) for i in range(9)] + [(9, ["a"], 10), (10, ["c"], 0)]
    frame = spark.createDataFrame(rows, "doc_id long, members array<string>, size long")
    found = {r.doc_id: r for r in mixture.mix(frame, "members", "size").collect()}
    # c has no words, so a and b share all by 5 to 2, and taking every document once fills both.
    assert found[9].target == pytest.approx(100 * 5 / 7) and found[9].source_size == 100
    assert found[10].target == 0
    assert {i: r.taken for i, r in found.items()} == {**{i: 10 for i in range(10)}, 10: 0}
    flow = mixture._cheapest({"p": (10, ["a", "b"]), "q": (10, ["a"])}, {"a": 25, "b": 12}, 3)
    to = {s: sum(w for (_, t), w in flow.items() if t == s) for s in ("a", "b")}
    from_ = {p: sum(w for (q, _), w in flow.items() if q == p) for p in ("p", "q")}
    assert to == {"a": 25, "b": 12}
    assert sum(max(w - 10, 0) + max(w - 20, 0) for w in from_.values()) == 17  # no third repeat


# 10 -----------------------------------------------------------------------------------------


def cut(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, flank, unit, letters", [(12, 4, 3, "ab"), (30, 8, 24, "abcdefgh"), (30, 8, 3, "ab")])
def test_repeated_substrings(spark, monkeypatch, length, flank, unit, letters):
    monkeypatch.setattr(substrings, "UNIT", unit)
    rnd = random.Random(length + unit)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(200))) for _ in range(6)]
    rows = []
    for i in range(60):
        text = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            if text:
                text[rnd.randrange(len(text))] = rnd.choice("abxyé")
        if i % 3 == 0:
            text = text[rnd.randrange(20) :] + list(rnd.choice(base))[:40]
        rows.append((i, "".join(text)))
    rows += [(90, None), (91, ""), (92, "z" * 100), (93, "Su " * 50), (94, rows[0][1]), (94, rows[0][1]), (None, rows[1][1])]
    found = substrings.cut_repeats(documents(spark, rows).withColumnRenamed("lang", "kept"), length, flank).collect()
    got = sorted(
        ((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in found), key=repr
    )
    assert got == cut(rows, length)


def test_driver_gets_bits_of_cores(spark, monkeypatch):
    """However many cores are sent out with bytes, the driver gets no row for each."""
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        text = [rnd.choice("abcdefgh") for _ in range(400)]
        rows.append((2 * i, "".join(text)))
        for at in range(20, 400, 40):
            text[at] = "x"
        rows.append((2 * i + 1, "".join(text)))
    held, kind, marked = [], type(spark.range(0)), substrings._with_bytes

    def with_bytes(marks, bits, *more):
        held.append(int(np.unpackbits(marks).sum()))
        return marked(marks, bits, *more)

    def counted(name, own):
        def run(frame):
            back = own(frame)
            held.append((name, len(back)))
            return back

        return run

    monkeypatch.setattr(substrings, "_with_bytes", with_bytes)
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, counted(name, getattr(kind, name)))
    frame = substrings.cut_repeats(documents(spark, rows), 30, 8)
    monkeypatch.undo()
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in frame.collect()), key=repr)
    assert found == cut(rows, 30)
    assert max(x for x in held if isinstance(x, int)) > 200
    assert all(x[1] <= 2 for x in held if isinstance(x, tuple))


@pytest.mark.parametrize("bits", [16, 20])
def test_marks_of_cores(spark, bits):
    rng = np.random.default_rng(bits)
    cores = np.concatenate([rng.integers(-(2**63), 2**63, 500, np.int64), [0, -1, -1, 2**63 - 1, -(2**63)]])
    marks = substrings._marked(spark.createDataFrame([(int(x),) for x in cores], "core long"), bits)
    slots = np.unique(cores.view(np.uint64) >> np.uint64(64 - bits))
    assert np.flatnonzero(np.unpackbits(marks, bitorder="little")).tolist() == slots.tolist()
    assert not substrings._marked(spark.createDataFrame([], "core long"), bits).any()


@pytest.mark.parametrize("size", [323, 399, 400, 401, 600])
def test_passages_go_from_400_bytes_on(spark, tmp_path, size):
    """Passages of more than 50 words that two texts share: the contract counts bytes, so shorter ones stay."""
    rnd = random.Random(size)

    def words(n_bytes):
        return " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n_bytes))[:n_bytes]

    passage = f" {words(size - 2)} "
    assert len(passage) == size and len(passage.split()) > 50
    sides = [words(300) for _ in range(4)]
    texts = [f"{sides[0]}1{passage}2{sides[1]}", f"{sides[2]}3{passage}4{sides[3]}", words(900)]
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op10_suffix_arrays"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        gone = size >= 400 and i < 2
        kept = text.replace(passage, "") if gone else text
        want = (len(text), size * gone, int(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, found[i].kept_sha256) == want


def shared_words(texts, passage):
    """For each text the words in passages that another one has; a text's equal passages count where they are first."""
    first = []
    for text in texts:
        words, own = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()), {}
        for i in range(len(words) - passage + 1):
            own.setdefault(tuple(words[i : i + passage]), i)
        first.append(own)
    holders = collections.Counter(p for own in first for p in own)
    return [len({i + k for p, i in own.items() if holders[p] > 1 for k in range(passage)}) for own in first]


@pytest.mark.parametrize("passage, flank, unit, kinds", [(6, 2, 3, 2), (12, 5, 24, 3), (12, 8, 2, 2), (9, 6, 3, 40)])
def test_shared_passages_of_words(spark, monkeypatch, passage, flank, unit, kinds):
    monkeypatch.setattr(substrings, "UNIT", unit)
    rnd = random.Random(passage + unit + kinds)
    names = [rnd.choice(["a", "bb", "é", "word", "Word"]) + str(i) for i in range(kinds)]
    base = [[rnd.choice(names) for _ in range(rnd.randrange(80))] for _ in range(6)]
    texts = [None, "", " \t ", "x " * 40, "y " * 30, "y\n" * 25]
    for i in range(60):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words.insert(rnd.randrange(len(words) + 1), rnd.choice([*names, f"own{i}"]))
        if i % 3 == 0:
            words = words[rnd.randrange(20) :] + rnd.choice(base)[:20] + words
        texts.append("".join(w + rnd.choice([" ", "  ", "\n", "\t"]) for w in words))
    texts.append(texts[-1])
    rows = [*enumerate(texts), (len(texts), texts[9]), (len(texts), texts[9]), (None, texts[8])]
    frame = documents(spark, rows).withColumnRenamed("lang", "n_shared_words")
    found = substrings.cut_repeats(frame, passage=passage, passage_flank=flank).collect()
    want = shared_words([text for _, text in rows], passage)
    assert sum(map(bool, want)) > 10 and min(want) == 0
    assert sorted((str(r.doc_id), r.n_shared_words) for r in found) == sorted((str(k), n) for (k, _), n in zip(rows, want))


@pytest.mark.parametrize("size", [49, 51, 55, 80])
def test_passages_of_words_across_documents(spark, tmp_path, size):
    """Passages of more than 50 words are seen in texts that share them, be they shorter than 400 bytes, and not
    in one that holds its own twice; what is removed stays as the contract has it."""
    rnd = random.Random(size)

    def words(n, letters):
        return ["".join(rnd.choices(letters, k=4)) for _ in range(n)]

    passage, own = words(size, "abcdefghij"), words(size, "klmnopqrst")
    sides = [" ".join(words(60, "abcdefghij")) for _ in range(4)]
    texts = [f"{sides[0]} {' '.join(passage)} {sides[1]}", f"{sides[2]}\n{'  '.join(passage)}\n{sides[3]}"]
    texts += [" ".join([*own, sides[0][:50], *own]), " ".join(words(200, "uvwxyz"))]
    documents(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op10_suffix_arrays"](spark, str(tmp_path)).collect()}
    shared = size * (size >= 50)
    assert [found[i].n_shared_words for i in range(4)] == [shared, shared, 0, 0]
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.values())
    assert rows == cut(list(enumerate(texts)), 400)


def test_repeated_substrings_of_nothing(spark):
    assert substrings.cut_repeats(documents(spark, [])).count() == 0


def test_other_columns_may_have_any_name(spark):
    """Columns named as the operators name their own change nothing."""
    rows = [(i, " ".join(f"w{j}" for j in range(20 + i % 3)), f"s{i % 2}") for i in range(12)]
    frame = documents(spark, rows)
    names = "kind set_id n shingle number sketch first size curve digest shard slot __rows id pattern members taken".split()
    more = frame.selectExpr("*", *[f"{i} AS {name}" for i, name in enumerate(names)])
    for run in (jaccard.near_copies, hilbert.shard_documents, mixture.mix_documents):
        assert sorted(map(str, run(more).collect())) == sorted(map(str, run(frame).collect()))
    vectors = spark.createDataFrame([(i, [float(i % 4), 1.0, 2.0]) for i in range(12)], "vec_id long, embedding array<float>")
    clash = vectors.selectExpr("*", *[f"{i} AS {name}" for i, name in enumerate("id weight first vector dims cell home near part".split())])
    assert sorted(map(str, metric.near_duplicates(clash).collect())) == sorted(map(str, metric.near_duplicates(vectors).collect()))
    pages = spark.createDataFrame([(i, f"http://a.b/{i % 5}", f"<p>{i % 3}") for i in range(30)], "page_id long, url string, html string")
    records = revisits.crawl(pages)
    odd = records.selectExpr("*", *[f"{i} AS {name}" for i, name in enumerate("place outcome full response_id slice".split())])
    assert sorted(map(str, revisits.resolve(odd).collect())) == sorted(map(str, revisits.resolve(records).collect()))
