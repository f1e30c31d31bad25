"""Mixing documents to target words per source as a min-cost flow.

A document can belong to several sources. Documents are aggregated by membership pattern (the set
of sources they belong to); a pattern offers its words up to REPEATS times, the first time at no
cost, each further time at a higher one (convex, so repeats are spread before they deepen). The flow
routes the patterns' words to the sources' quotas at least cost. Patterns and sources that are not
connected share no capacity, so each connected part of that graph is solved in a task of its own;
a part's size is the number of its membership patterns, never that of documents.

Inside a pattern every document is taken floor(flow / words) times, and a seeded choice once more, in turns of one rule:
of the documents that are not chosen and fit what is left, those go in, by seeded digest, whose running total fits too,
and then the longest one that still fits. Turns end when no document fits; all that fit after a turn are at most as long
as its last one, so each turn at least halves what is left or takes all there is. So a source's words miss its quota by
less than its smallest document that is left.

Targets: sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops
at REPEATS times its source's words, and the excess is shared by weight until none is above.

Null and empty texts have size 0 and are never taken. A document without a source belongs to the
null source. The digest is of id, size and text, so rows that share an id are spread. Repeated rows are documents of
their own that tie in order: they are taken alike, but for those at the edge of the choice. An empty table gives no rows.
Of other columns none is read, whatever its name.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tailrace.llm.components import components
from tailrace.plans.tables import Tables

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
ROUTES = "pattern string, source string, words long"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size, target from one row per source: source, source_size, and the words of all
    documents in total_size (the same in every row). Windows here order sources, one row each.

    With caps c and weights w in ascending c / w, the level at which the k-th would be the first source
    below its cap is (total - caps before it) / (weights from it on); the highest level is the one."""
    ranked = W.orderBy(F.asc_nulls_last("source"))
    cycle = F.array(*[F.lit(w) for w in WEIGHTS])
    weight = F.element_at(cycle, ((F.row_number().over(ranked) - 1) % len(WEIGHTS)) + 1).cast("long")
    rows = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * REPEATS)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    done = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing))
    level = F.struct(((F.col("total_size") - done) / rest).alias("at"), (F.col("total_size") - done).alias("n"), rest.alias("d"))
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(W.partitionBy()))
    share = F.col("level.n") * F.col("weight") / F.col("level.d")
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def _cheapest(patterns: dict, quotas: dict, repeats: int) -> dict:
    """Words by (pattern, source) of the flow that fills the quotas as far as possible at least cost.

    patterns: name -> (words, sources). quotas: source -> words. Augments along shortest paths in the
    graph start -> pattern (one arc per repeat, costing its number) -> source -> end."""
    arcs, out = [], defaultdict(list)  # arc: [to, capacity, cost]; arc ^ 1 goes back

    def arc(a, b, capacity, cost):
        for tail, head, room, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[tail].append(len(arcs))
            arcs.append([head, room, price])

    for name, (words, sources) in sorted(patterns.items()):
        for level in range(repeats):
            arc("start", ("p", name), words, level)
        for source in sources:
            arc(("p", name), ("s", source), words * repeats, 0)
    for source, quota in sorted(quotas.items(), key=lambda x: (x[0] is None, x[0] or "")):
        arc(("s", source), "end", quota, 0)
    potential = defaultdict(int)
    while True:
        best, came, heap, order = {"start": 0}, {}, [(0, 0, "start")], 1
        while heap:
            cost, _, node = heapq.heappop(heap)
            if cost > best[node]:
                continue
            for i in out[node]:
                head, room, price = arcs[i]
                new = cost + price + potential[node] - potential[head]
                if room > 0 and new < best.get(head, new + 1):
                    best[head], came[head] = new, i
                    heapq.heappush(heap, (new, order, head))
                    order += 1
        if "end" not in best:
            break
        far = best["end"]
        for node in list(out):
            potential[node] += min(best.get(node, far), far)
        path, node = [], "end"
        while node != "start":
            path.append(came[node])
            node = arcs[came[node] ^ 1][0]
        room = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= room
            arcs[i ^ 1][1] += room
    flows = defaultdict(int)
    for name in patterns:
        for i in out[("p", name)]:
            head = arcs[i][0]
            if head[0] == "s" and not i % 2:
                flows[name, head[1]] += arcs[i ^ 1][1]
    return {key: words for key, words in flows.items() if words}


def routes(patterns: DataFrame, quotas: DataFrame, tables: Tables, repeats: int = REPEATS) -> DataFrame:
    """(pattern, source, words) of the cheapest flow. patterns: pattern, members, words. quotas: source,
    target."""
    arcs = patterns.select("pattern", "words", F.explode("members").alias("source"))
    arcs = arcs.join(quotas.select(F.col("source").alias("__source"), "target"), F.expr("source <=> __source"))
    arcs = arcs.select(
        "pattern",
        "words",
        "source",
        F.round("target").cast("long").alias("quota"),
        F.xxhash64(F.lit("p"), "pattern").alias("pattern_node"),
        F.xxhash64(F.lit("s"), "source").alias("source_node"),
    )
    arcs = tables.write(arcs, "arcs")
    parts = components(arcs.select("pattern_node", "source_node"), tables, "parts")
    parts = arcs.join(parts, arcs["pattern_node"] == parts["node"], "left")
    parts = parts.withColumn("part", F.coalesce("component", "pattern_node"))

    def solved(part: pd.DataFrame) -> pd.DataFrame:
        source = [None if pd.isna(s) else s for s in part["source"]]
        members = defaultdict(list)
        for name, s in zip(part["pattern"], source):
            members[name].append(s)
        words = dict(zip(part["pattern"], part["words"]))
        flow = _cheapest(
            {name: (int(words[name]), members[name]) for name in members},
            {s: int(q) for s, q in zip(source, part["quota"])},
            repeats,
        )
        return pd.DataFrame([(p, s, w) for (p, s), w in flow.items()], columns=["pattern", "source", "words"])

    return parts.select("part", "pattern", "words", "source", "quota").groupBy("part").applyInPandas(solved, ROUTES)


def mix(
    documents: DataFrame,
    members: str,
    size: str,
    key: str = "doc_id",
    name: str | None = None,
    also: str | None = None,
    seed: str = "0",
) -> DataFrame:
    """Adds taken (words, whole repeats of a document) to the key, members and size of each document,
    and the source_size and target of its first source.

    members: an array of the sources that a document belongs to. size: its words. key: its id. The choice depends on
    size, name (default: key) and also, a text that tells rows of one name apart.
    """
    tables = Tables(documents.sparkSession)
    told = F.col(also) if also else F.lit(None).cast("string")
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col(name or key), F.col(size), told)]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *parts))
    rows = tables.write(
        documents.select(
            F.col(key).alias("id"),
            F.col(size).alias("size"),
            F.array_sort(F.array_distinct(members)).alias("members"),
            digest.alias("digest"),
        ).withColumn("pattern", F.to_json("members")),
        "rows",
    )
    patterns = tables.write(
        rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.first("members").alias("members")), "patterns"
    )
    total = patterns.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    sources = patterns.select(F.explode("members").alias("source"), "words").groupBy("source")
    sources = sources.agg(F.sum("words").alias("source_size"), F.lit(total).alias("total_size"))
    quotas = tables.write(targets(sources), "quotas")
    flow = routes(patterns, quotas, tables).groupBy("pattern").agg(F.sum("words").alias("flow"))
    first = patterns.withColumn("__first", F.col("members")[0]).join(
        quotas, F.expr("__first <=> source"), "left"
    )
    plan = first.join(flow, "pattern", "left").select(
        "pattern",
        "source_size",
        "target",
        F.when(F.col("words") > 0, F.expr("coalesce(flow, 0) div words")).otherwise(0).alias("copies"),
        F.when(F.col("words") > 0, F.expr("coalesce(flow, 0) % words")).otherwise(0).alias("rest"),
    )
    plan = tables.write(plan, "plan")
    chosen = _one_more(rows, plan, tables)
    taken = F.col("size") * (F.col("copies") + F.coalesce(F.col("more"), F.lit(0)))
    return chosen.select(
        F.col("id").alias(key), "members", "size", "source_size", "target", taken.cast("long").alias("taken")
    )


def _one_more(rows: DataFrame, plan: DataFrame, tables: Tables) -> DataFrame:
    """rows with plan and more: 1 for a seeded choice of each pattern's rows whose sizes come to `rest`.

    The digest's first three digits deal a pattern's rows in 4,096 slices, so that no task orders more
    than a slice of one pattern."""
    within = W.partitionBy("pattern", "slice").orderBy("digest", "size", "id")
    sliced = rows.withColumn("slice", F.substring("digest", 1, 3))
    dealt = tables.write(sliced.withColumn("place", F.row_number().over(within)), "dealt")
    row = ["pattern", "slice", "place"]
    out = dealt.where("size > 0").select(*row, "size", "digest")
    left, picks, turn = plan.select("pattern", F.col("rest").alias("left")), None, 0
    while True:
        fits = out.join(left, "pattern").where("size <= left")
        fits = fits if picks is None else fits.join(picks, row, "left_anti")
        fits = tables.write(fits, f"fits-{turn}")
        if fits.isEmpty():
            break
        totals, slices = _sliced_totals(fits)
        first = totals.join(slices, ["pattern", "slice"]).where("done + within <= left").select(*row, "size", "left")
        first = tables.write(first, f"prefix-{turn}")
        rest = first.groupBy("pattern").agg((F.max("left") - F.sum("size")).alias("rest"))
        best = F.max(F.struct("size", "digest", "slice", "place")).alias("best")
        fill = fits.join(rest, "pattern").where("size <= rest").join(first, row, "left_anti").groupBy("pattern").agg(best)
        fill = tables.write(fill.select("pattern", "best.slice", "best.place", F.col("best.size").alias("longest")), f"fill-{turn}")
        after = F.col("rest") - F.coalesce("longest", F.lit(0))
        left = tables.write(rest.join(fill, "pattern", "left").select("pattern", after.alias("left")), f"left-{turn}")
        new = first.select(row).union(fill.select(row))
        picks = new if picks is None else picks.union(new)
        tables.drop(f"fits-{turn}")
        turn += 1
    if picks is None:
        picks = out.limit(0).select(row)
    picked = dealt.join(picks.withColumn("picked", F.lit(True)), row, "left").join(plan, "pattern")
    return picked.withColumn("more", F.coalesce("picked", F.lit(False)).cast("int"))


def _sliced_totals(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with `within`, the running total of size in their slice, and by pattern and slice `done`, the
    total of the slices before it."""
    before = W.partitionBy("pattern").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = rows.groupBy("pattern", "slice").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("done", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    total = F.sum("size").over(W.partitionBy("pattern", "slice").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("within", total), slices


def mix_rows(documents: DataFrame, key: str = "doc_id", seed: str = "0") -> DataFrame:
    """Mixes documents whose one source is their pattern; the result has `key` in place of doc_id, the choice is the
    same for any key."""
    size, text = n_words(F.col("text")).alias("__size"), F.md5("text").alias("__md5")
    rows = documents.select(F.col(key).alias("__key"), F.col("doc_id").alias("__name"), F.array("source").alias("__members"), size, text)
    mixed = mix(rows, "__members", "__size", "__key", "__name", "__md5", seed)
    return mixed.select(F.col("__key").alias(key), F.col("size"), "source_size", "target", "taken")


def mix_documents(documents: DataFrame, seed: str = "0") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix_rows(documents, seed=seed)
