"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tailrace.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    found = {}
    for conv_id, turn, role, text in rows:
        own = found.setdefault(conv_id, [])
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        case = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(case, 1)
    return found


def after(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def search(rows):
    """The summary of one conversation; edits by the cheapest, then least, path."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
    seen, faults, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        if fault:
            counts[fault] += 1
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in out))
            text = "\n".join(f"{role}:{text}" for role, text in out)
            return gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()
        ways = [(3, "I", i, role, "") for role in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                ways += [(more, "K", i + 1, role, text)]
                ways += [(3 + more, "R", i + 1, other, text) for other in ("user", "assistant")]
        for price, letter, at, role, text in ways:
            if after(state, role[:1]):
                heapq.heappush(heap, (cost + price, audit + letter, at, after(state, role[:1]), (*out, (role, text))))


def random_rows(seed, conversations=250):
    rnd, rows = random.Random(seed), []
    roles = ["user", "assistant"] * 2 + ["system", None, "", "tool", "ü", "admin"]
    texts = [None, "", " \t", "a.", "b", "c!", "Hello. ", "d?\n", "é", "x ", "e.f", " "]
    for conv_id in [*range(conversations), None]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 30])):
            number = None if rnd.random() < 0.05 else turn + rnd.choice([0, 0, 0, 2])
            rows.append((conv_id, number, rnd.choice(roles), rnd.choice(texts)))
    return rows


def repaired(frame, **options):
    rows, dropped = turns.damaged(frame)
    return sorted(map(tuple, turns.repaired(rows, dropped, **options).collect()), key=repr)


def want(rows):
    return sorted([(conv_id, *search(own)) for conv_id, own in damaged(rows).items()], key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_random_conversations(spark, seed):
    rows = random_rows(seed)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).selectExpr("*", "1 AS copy", "2 AS fault", "true AS dropped", "true AS lost")
    assert repaired(frame) == want(rows)


def test_spilled_backpointers(spark):
    """Backpointers leave the task after every three rows; across Arrow batches of five."""
    rows = random_rows(7, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(3), spill_rows=3) == want(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_giant_conversation(spark):
    rnd = random.Random(4)
    rows = [(1, i, rnd.choice(["user", "assistant"]), f"text {i}" + rnd.choice([".", "", "?"])) for i in range(4_000)]
    rows += [(2, 0, "user", "long " * 300_000 + "."), (2, 1, "assistant", "yes.")]
    found = repaired(spark.createDataFrame(rows, SCHEMA).repartition(5), spill_rows=1_000)
    assert found == want(rows)


def test_edited_rows_are_what_was_hashed(spark):
    rows = random_rows(9, 80)
    frame, dropped = turns.damaged(spark.createDataFrame(rows, SCHEMA))
    summary = turns.repaired(frame, dropped)
    by_id = {}
    for r in sorted(turns.edited(frame, summary, dropped).collect(), key=lambda r: r.position):
        assert r.position == len(by_id.setdefault(r.conv_id, []))
        by_id[r.conv_id].append(f"{r.role}:{r.text}")
    for r in summary.collect():
        assert hashlib.sha256("\n".join(by_id.get(r.conv_id, [])).encode()).hexdigest() == r.repaired_sha256


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repaired(empty) == []
    only = spark.createDataFrame([(3, 1, "user", "a.")], SCHEMA)
    from pyspark.sql import functions as F

    (row,) = turns.repaired(only, F.lit(True)).collect()
    assert tuple(row) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
