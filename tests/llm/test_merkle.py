"""The manifest against a tree built row by row."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tailrace.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(nodes):
    """Proofs (text before, text after, for each level) of the nodes, and the root."""
    proofs, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, at in zip(proofs, where):
            other = at ^ 1
            proof.append((nodes[other] if other < at else "", nodes[other] if at < other < len(nodes) else ""))
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return proofs, nodes[0]


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    found, subroots = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = []
        for row in groups[lang]:
            other = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                other[3] += 1
            leaves.append((row[0], leaf(row), leaf(other)))
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        proofs, subroot = tree([x[1] for x in leaves])
        subroots.append(subroot)
        found.append((leaves, proofs))
    if not found:
        return []
    tops, root = tree(subroots)
    result = []
    for (leaves, proofs), subroot, top in zip(found, subroots, tops):
        for (doc_id, own, other), proof in zip(leaves, proofs):
            node = other
            for before, after in proof + top:
                node = digest(before, node, after)
            siblings = digest(*[b + a for b, a in proof + top])
            result.append((doc_id, own, subroot, root, siblings, node, node == root))
    return sorted(result, key=repr)


def manifest(docs):
    changed = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = merkle.manifest(docs, {"n_chars": F.col("n_chars") + 1}, changed)
    root = merkle.fold(F.col("found_leaf"), F.col("proof"))
    siblings = merkle.proof_digest(F.col("proof"))
    found = rows.select("doc_id", "leaf", "subroot", "root", siblings, root, root == F.col("root"))
    return sorted(map(tuple, found.collect()), key=repr)


def test_random_documents(spark):
    """Sparse, dense, negative and shared ids, nulls in any column, repeated rows, several blocks and buckets."""
    rnd = random.Random(3)
    rows = []
    for i in range(6_000):
        doc_id = rnd.choice([None, 7, -5, 10**12, 2**63 - 1, -(2**63)])
        if rnd.random() < 0.6:
            doc_id = rnd.randrange(-50_000, 5_000_000 if i % 2 else 60_000)
        langs = [None, "en", "en", "zz", "", "ü", "\U0001f600"]
        rows.append((doc_id, rnd.choice([None, "s", "é"]), rnd.choice(langs), rnd.choice([None, 3, 4]), rnd.choice([None, "", "a", "ab"])))
    rows += rows[:500]
    assert manifest(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_one_id_for_most_rows(spark):
    """Runs of equal leaves longer than a block, and different leaves under one id."""
    rows = [(4, "s", "en", 1, "same")] * 2_500 + [(4, "s", "en", i, "other") for i in range(300)] + [(None, None, "en", None, None)] * 1_100
    rows += [(i, "s", "en", 2, "x" * i) for i in range(200)]
    assert manifest(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 1_023, 1_024, 1_025])
def test_sizes_about_a_block(spark, count):
    rows = [(i, "s", "en", 2, "text " * (i % 3)) for i in range(count)]
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_groups_and_other_columns(spark):
    rows = [(i, None, f"lang {i}", 1, "") for i in range(1_500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    extra = docs.selectExpr("*", "7 AS grp", "'x' AS leaf", "'y' AS total", "0 AS bucket", "1 AS position")
    assert manifest(extra) == brute(rows)


def test_long_text(spark):
    rows = [(1, "s", "en", 2, "long ü " * 400_000), (2, "s", "en", 2, "short")]
    assert manifest(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_positions_follow_ids(spark):
    rows = [(i * 3, "s", "de", 1, "t") for i in range(3_000)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4)).select("doc_id", "position").collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: r.position)] == [r[0] for r in rows]
    assert sorted(r.position for r in found) == list(range(3_000))
