"""Cheapest repair of conversations whose turns alternate, by a streamed dynamic program.

Rows are repartitioned by conversation and sorted by turn (null first; ties by role and text). mapInPandas reads a
partition's rows in that order and carries the program's state across Arrow batches: for each state of the automaton of
legal role sequences, `(s?(ua)+)?` of role initials, the least cost, the rank of its edits in ASCII order and a running
hash of the repaired text. A row adds one compact backpointer (four bytes: for each state where it came from, what was
inserted, which edit). A conversation is never held. After SPILL_ROWS backpointers they leave the task as a row of the
result table, which Spark stores; only conversations longer than that are traced back in a second pass that streams
those rows from the last to the first. One conversation stays in one task, as its text is hashed in order, but needs
memory for one batch and SPILL_ROWS backpointers only (its audit has one character for each edit).

Faults, the first that holds counts   blank: nothing but white space; duplicate: role and text were seen before in the
conversation; truncated: the last character that is not white space is none of `.!?`
Edits   Keep 0; Rerole to user or assistant 3; Delete 4, required for blank and duplicate rows; Insert of an empty turn of
user or assistant 3; a truncated row that is not deleted adds 3

Among the cheapest the edits whose initials come first in ASCII order are taken. A null role or text counts as one space, a
null turn comes first and is no number; rows without conv_id are one conversation. A conversation without rows is
reported if `dropped` rows name it. An empty table gives no rows. Columns other than conv_id, turn, role and text are not
read, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tailrace.plans.tables import Tables

# Costs of the edits, roles that are inserted, legal pairs of neighbouring role initials.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"
LEGAL = {"su", "ua", "au"}

# States: nothing yet, a system turn, a user turn, an assistant turn last.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): ASKED, (SYSTEM, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
# The turn that is inserted after each state, and the state then.
NEXT = {NOTHING: (USER, ASKED), SYSTEM: (USER, ASKED), ASKED: (ASSISTANT, ANSWERED), ANSWERED: (USER, ASKED)}
MOST_INSERTS = 2  # two turns in a row lead from any state to a complete one
LETTERS = "KRD"
SPILL_ROWS = 1 << 20
SPACE = " \t\n\x0b\x0c\r"

# kind 0 is a conversation's result, kind 1 a run of its backpointers.
STREAMED = (
    "conv_id long, kind int, part long, pointers binary, state int, gaps long, blank long, duplicate long,"
    " truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def fault_of(text: Column, number: Column) -> Column:
    """The first fault of a row; number counts the rows of equal role and text from 1."""
    bare = F.rtrim(text, F.lit(SPACE))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    blank = (bare == "") | ~text.rlike(r"[^\x20\x09-\x0D]")
    return F.when(blank, "blank").when(number > 1, "duplicate").when(~ends, "truncated")


def marked(rows: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, dropped and fault, by conversation and in order; one exchange."""
    kept = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.coalesce(dropped, F.lit(False)) if dropped is not None else F.lit(False)).alias("dropped"),
    )
    seen = W.partitionBy("conv_id", "dropped", "role", "text").orderBy("turn")
    numbered = kept.repartition("conv_id").withColumn("copy", F.row_number().over(seen))
    judged = numbered.withColumn("fault", fault_of(F.col("text"), F.col("copy")))
    return judged.sortWithinPartitions("conv_id", "dropped", "turn", "role", "text", "copy").drop("copy")


# The dynamic program --------------------------------------------------------------------------------


def _choices(state: int, initial: str, fault: str | None) -> list[tuple[int, int, str, int]]:
    """(next state, inserts, letter, cost) of every way to pass a row from a state."""
    found = []
    for inserts in range(MOST_INSERTS + 1):
        extra = TRUNCATED if fault == "truncated" else 0
        if fault not in ("blank", "duplicate"):
            if (state, initial) in STEP:
                found.append((STEP[state, initial], inserts, "K", inserts * INSERT + extra))
            found.append((NEXT[state][1], inserts, "R", inserts * INSERT + REROLE + extra))
        found.append((state, inserts, "D", inserts * INSERT + DELETE))
        state = NEXT[state][1]
    return found


class Shapes:
    """Steps of the program by what they depend on alone: costs beyond the least and ranks of the states, and the row."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}

    def step(self, shape: tuple, initial: str, fault: str | None) -> tuple:
        """(next shape, what the least cost grows by, backpointer, moves). moves: for each state None or
        (state before, inserts, letter)."""
        key = (shape, initial if initial in ("s", "u", "a") else "", fault)
        if key not in self.known:
            best: list[tuple | None] = [None] * 4
            for before, entry in enumerate(shape):
                if entry is None:
                    continue
                for after, inserts, letter, cost in _choices(before, initial, fault):
                    # Edits of different states differ before they end, so ranks decide, then what is added.
                    value = (entry[0] + cost, entry[1], "I" * inserts + letter, before, inserts, letter)
                    if best[after] is None or value < best[after]:
                        best[after] = value
            least = min(b[0] for b in best if b)
            order = sorted((b[1], b[2], after) for after, b in enumerate(best) if b)
            ranks = {after: rank for rank, (_, _, after) in enumerate(order)}
            following = tuple(b and (b[0] - least, ranks[after]) for after, b in enumerate(best))
            moves = tuple(b and b[3:] for b in best)
            pointer = sum((m[0] | m[1] << 2 | LETTERS.index(m[2]) << 4) << (8 * after) for after, m in enumerate(moves) if m)
            self.known[key] = (following, least, pointer, moves)
        return self.known[key]


def traced(pointers: array, state: int) -> tuple[str, int]:
    """The initials of the edits that lead to a state, and the state before them."""
    found = []
    for pointer in reversed(pointers):
        code = pointer >> (8 * state) & 255
        found.append(LETTERS[code >> 4] + "I" * (code >> 2 & 3))
        state = code & 3
    return "".join(found)[::-1], state


class Conversation:
    """The state of the program after some rows of a conversation."""

    def __init__(self, conv_id: object, shapes: Shapes):
        self.conv_id, self.shapes = conv_id, shapes
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.cost = self.parts = 0
        self.before: str | None = None
        self.turns: tuple[int, int, int] | None = None  # first, last and number of different turns
        self.shape: tuple = ((0, 0), None, None, None)
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.pointers = array("I")

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            first, last, n = self.turns or (turn, turn, 1)
            self.turns = (first, turn, n + (turn != last))
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL:
            self.illegal += 1
        self.before = initial
        self.shape, grown, pointer, moves = self.shapes.step(self.shape, initial, fault)
        self.cost += grown
        self.pointers.append(pointer)
        body = None
        hashes: list = [None] * 4
        for after, move in enumerate(moves):
            if move is None:
                continue
            state, inserts, letter = move
            digest = self.hashes[state]
            if inserts or letter != "D":
                digest = digest.copy()
                state = self.insert(digest, state, inserts)
                if letter != "D":
                    if body is None:
                        body = (":" + text).encode("utf-8", "surrogatepass")
                    name = role if letter == "K" else NEXT[state][0]
                    digest.update(("\n" * (state != NOTHING) + name).encode("utf-8", "surrogatepass"))
                    digest.update(body)
            hashes[after] = digest
        self.hashes = hashes

    @staticmethod
    def insert(digest, state: int, inserts: int) -> int:
        for _ in range(inserts):
            digest.update(("\n" * (state != NOTHING) + NEXT[state][0] + ":").encode())
            state = NEXT[state][1]
        return state

    def spilled(self) -> tuple:
        row = (self.conv_id, 1, self.parts, self.pointers.tobytes(), *[None] * 9)
        self.parts += 1
        self.pointers = array("I")
        return row

    def result(self) -> tuple:
        ends = {NOTHING: 0, ANSWERED: 0, ASKED: 1, SYSTEM: 2}
        _, _, _, inserts, state = min(
            (entry[0] + INSERT * ends[s], entry[1], "I" * ends[s], ends[s], s) for s, entry in enumerate(self.shape) if entry
        )
        digest = self.hashes[state].copy()
        self.insert(digest, state, inserts)
        audit, before = traced(self.pointers, state)
        first, last, n = self.turns or (0, 0, 1)
        cost = self.cost + self.shape[state][0] + INSERT * inserts
        counts = (self.counts["blank"], self.counts["duplicate"], self.counts["truncated"], self.illegal, cost)
        gaps = last - first + 1 - n
        return (self.conv_id, 0, self.parts, None, before, gaps, *counts, audit + "I" * inserts, digest.hexdigest())


def _streamed(spill_rows: int):
    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes, now, names = Shapes(), None, [c.split()[0] for c in STREAMED.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names, dtype=object)

        for batch in batches:
            rows = []
            conv_ids, turns = batch["conv_id"].astype(object), batch["turn"].astype(object)
            lost, no_turn = batch["conv_id"].isna(), batch["turn"].isna()
            columns = zip(conv_ids, lost, turns, no_turn, batch["role"], batch["text"], batch["dropped"], batch["fault"])
            for conv_id, no_id, turn, numberless, role, text, dropped, fault in columns:
                conv_id = None if no_id else int(conv_id)
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        rows.append(now.result())
                    now = Conversation(conv_id, shapes)
                if dropped:
                    continue
                now.add(None if numberless else int(turn), role, text, fault if isinstance(fault, str) else None)
                if len(now.pointers) >= spill_rows:
                    rows.append(now.spilled())
            if rows:
                yield frame(rows)
        if now is not None:
            yield frame([now.result()])

    return stream


def _traced_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Initials of the edits of each run of backpointers; runs come from the last to the first of a conversation."""
    state = None
    for batch in batches:
        rows = []
        for conv_id, part, pointers, end in zip(batch["conv_id"], batch["part"], batch["pointers"], batch["state"]):
            if pointers is None:
                state = int(end)
            else:
                run = array("I")
                run.frombytes(pointers)
                letters, state = traced(run, state)
                rows.append((conv_id, part, letters))
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "part", "letters"]).astype({"conv_id": object})


def repaired(rows: DataFrame, dropped: Column | None = None, spill_rows: int = SPILL_ROWS) -> DataFrame:
    """One row per conversation: gaps (turns that are missing between the first and the last), blank, duplicate,
    truncated (rows by first fault), illegal (neighbours whose roles may not follow one another), cost, audit (initials
    of the cheapest edits in order) and repaired_sha256 (of the repaired `role:text`, joined by newlines). Rows that
    `dropped` marks are left out, but their conversation is reported."""
    tables = Tables(rows.sparkSession)
    found = tables.write(marked(rows, dropped).mapInPandas(_streamed(spill_rows), STREAMED), "streamed")
    result = found.where("kind = 0").select("conv_id", *SUMMARY, "audit", "repaired_sha256", "part")
    if not found.where("kind = 1").limit(1).count():
        return result.drop("part")
    long = found.where("part > 0 or kind = 1").select("conv_id", "part", "pointers", "state")
    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"))
    runs = ordered.mapInPandas(_traced_back, "conv_id long, part long, letters string")
    early = runs.groupBy(F.col("conv_id").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("part", "letters"))).alias("runs"))
    early = early.select("__id", F.array_join("runs.letters", "").alias("early"))
    joined = result.join(early, F.col("conv_id").eqNullSafe(F.col("__id")), "left")
    return joined.withColumn("audit", F.concat(F.coalesce("early", F.lit("")), "audit")).select(*result.drop("part").columns)


def edited(rows: DataFrame, summary: DataFrame, dropped: Column | None = None) -> DataFrame:
    """The repaired conversations by the audits of `summary`: conv_id, position from 0, edit, turn (null for what is
    inserted), role, text. Rows by rows, without Python."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = marked(rows, dropped).where("not dropped").withColumn("row", F.row_number().over(order)).drop("dropped", "fault")
    letters = summary.select("conv_id", F.posexplode(F.split("audit", "")).alias("at", "edit")).where("edit <> ''")
    so_far = W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    letters = letters.withColumn("row", F.sum(F.when(F.col("edit") != "I", 1).otherwise(0)).over(so_far))
    letters = letters.where("edit <> 'D'").withColumn("position", F.count("*").over(so_far) - 1)
    letters = letters.withColumn("match", F.when(F.col("edit") != "I", F.col("row"))).withColumnRenamed("conv_id", "__id")
    met = F.col("__id").eqNullSafe(F.col("conv_id")) & (F.col("match") == own["row"])
    joined = letters.drop("row").join(own, met, "left").drop("conv_id").withColumnRenamed("__id", "conv_id")
    # A system turn can stand first only; users and assistants alternate after it.
    first = W.partitionBy("conv_id").orderBy("position").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    system = F.first(F.when((F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(first)
    named = F.when((F.col("position") - system) % 2 == 0, USER).otherwise(ASSISTANT)
    role = F.when(F.col("edit") == "K", F.col("role")).otherwise(named)
    return joined.withColumn("role", role).select("conv_id", "position", "edit", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> tuple[DataFrame, Column]:
    """Rows with faults that depend on conv_id and turn alone, and which of them are dropped: by the checksum of
    `conv_id:turn` modulo 20, 0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes its role user."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(number("conv_id"), F.lit(":"), number("turn"))
    case = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(case == 4, USER).otherwise(role).alias("role"),
        F.when(case.isin(0, 1), "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (case == 0).alias("lost"),
        F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy"), F.col("lost")
