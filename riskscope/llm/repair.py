"""Conversation structure repair (operator 13): scalar big-integer weights.

Rows become the conversation ``(s?(ua)+)?`` at the least cost.  Keep costs 0,
rerole and insert 3, delete 4, and a truncated row that stays 3 more.  An edge
of the DAG (row, role read last) weighs one integer: its cost in the high
digits, its audit letter in one of ``WIDTH`` low digits, left to right, zeros
at the end.  The least integer therefore is the least cost and among those the
ASCII-least audit, and plain ``min`` decides everything.

Two paths to one node are never such that one's audit begins the other's at the
same cost: letters fix both the costs and the rows read, and further letters
could only be inserts.  So they differ at a digit both have.  Right after a row's letter
that holds between states too, which lets the digits start afresh: before they
run out, each state's audit so far is put aside and replaced by its rank among
the (at most four) states, so integers stay short however long the conversation
is.

Rows stream through sorted partitions.  A task holds per conversation four
weights and the audit letters, never the texts; a conversation is one task's
work since its repaired texts have one digest.  Rows seen earlier are found by
an aggregate before.

Nulls are read as one space, in conv_id's and turn's place within the damage
key too; null turns come first, and a null conv_id is a conversation of its
own.  Ties of turn go by role, then text.  An empty role has no initial, is
never kept, and makes its pairs illegal.  Repeated rows are duplicates.
Empty texts are blank.  An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskscope.llm.common import stored

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WIDTH = 60                                       # letters that an integer holds
BASE = 5
_CODE = {"D": 1, "I": 2, "K": 3, "R": 4}         # ASCII order, zero ends
_UNIT = [BASE ** (WIDTH - 1 - p) for p in range(WIDTH)]
_COST = BASE ** WIDTH

START, SYSTEM, USER, ASSISTANT = range(4)        # the role read last
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_PATH = "conv_id long, turn long, role string, text string"


class Plan:
    """Shortest paths over the rows of one conversation, row by row."""

    def __init__(self):
        # state: (weight, letters since the last rebase, earlier letters as a linked list)
        self.states: dict[int, tuple[int, int, tuple | None]] = {START: (0, 1, None)}
        self._inserts()

    def _edge(self, into: dict, state: int, path: tuple, cost: int, letter: str) -> bool:
        weight, at, past = path
        weight += cost * _COST + _CODE[letter] * _UNIT[at]
        if state in into and into[state][0] <= weight:
            return False
        into[state] = (weight, at + 1, past)
        return True

    def _inserts(self) -> None:
        """Inserts after the row read last.  A third in succession would come
        back to a role it left, at a higher cost."""
        for _ in range(2):
            for state, path in sorted(self.states.items()):
                self._edge(self.states, _NEXT[state], path, INSERT, "I")

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        into: dict[int, tuple] = {}
        extra = TRUNCATED if truncated else 0
        for state, path in self.states.items():
            self._edge(into, state, path, DELETE, "D")
            if must_go:
                continue
            kept = _KEPT.get((state, initial))
            if kept is not None:
                self._edge(into, kept, path, KEEP + extra, "K")
            self._edge(into, _NEXT[state], path, REROLE + extra, "R")
        self.states = into
        if max(at for _, at, _ in into.values()) + 3 > WIDTH:
            self._rebase()
        self._inserts()

    def _rebase(self) -> None:
        """Put the letters aside; their rank takes the first digit.  All end
        with the same row's letter, so none begins another."""
        ranks = {low: r for r, low in enumerate(sorted(w % _COST for w, _, _ in self.states.values()))}
        self.states = {s: (w - w % _COST + ranks[w % _COST] * _UNIT[0], 1, (past, _letters(w % _COST)))
                       for s, (w, _, past) in self.states.items()}

    def best(self) -> tuple[int, str]:
        weight, _, past = min(self.states[s] for s in (START, ASSISTANT) if s in self.states)
        parts = [_letters(weight % _COST)]
        while past is not None:
            past, letters = past
            parts.append(letters)
        return weight // _COST, "".join(reversed(parts))


def _letters(low: int) -> str:
    """The letters of the low digits, without the rank before them."""
    digits = []
    while low:
        low, d = divmod(low, BASE)
        digits.append(d)
    digits = ([0] * (WIDTH - len(digits)) + digits[::-1])[1:]
    return "".join(" DIKR"[d] for d in digits).rstrip()


def rows_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text under fixed names; null roles and texts are
    one space."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that their key's crc32 decides: 0 drops the row, 1
    empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the
    user's.  Dropped rows stay, as ``gone``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows_of(conversations).withColumn("__hit", F.crc32(key) % 20)
    hit = F.col("__hit")
    times = F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (hit == 0).alias("gone"),
                       F.explode(times).alias("__copy")).drop("__copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with each row's first fault:
    blank, duplicate, truncated or null.  Of rows that share turn, role and
    text the stream calls all but the first duplicates."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\v\f\r")), F.lit(1))
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = rows.withColumn("__said", said).withColumn("__last", last)
    # Rows said at several turns: few, as a rule.  Null turns come first.
    again = (marked.where("not gone").groupBy(F.col("conv_id").alias("__conv"), F.col("__said").alias("__what"))
             .agg(F.min(F.struct("turn")).alias("__first"), F.max(F.struct("turn")).alias("__latest"))
             .where(~F.col("__first").eqNullSafe(F.col("__latest"))).select("__conv", "__what", "__first"))
    found = marked.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("__said") == F.col("__what")), "left")
    earlier = F.col("__first").isNotNull() & ~F.col("__first.turn").eqNullSafe(F.col("turn"))
    fault = (F.when(F.col("__last") == "", "blank").when(earlier, "duplicate")
             .when(~F.col("__last").isin(".", "!", "?"), "truncated"))
    return found.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"))


REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
_REPORT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class _Report:
    """What one conversation's rows come to, in order."""

    def __init__(self, conv):
        self.conv, self.plan, self.before = conv, Plan(), None
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def row(self, turn, role: str, text: str, fault) -> None:
        if fault != "blank" and self.before == (turn, role, text):
            fault = "duplicate"
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.illegal += self.before[1][:1] + role[:1] not in _LEGAL
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.before = (turn, role, text)
        self.plan.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")

    def closed(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.values(), self.illegal, *self.plan.best())


def plan_repairs(marked: DataFrame) -> DataFrame:
    """One row a conversation: its faults, the least cost and the audit."""
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("gone"), "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            out = []
            for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != now.conv:
                    if now is not None:
                        out.append(now.closed())
                    now = _Report(conv)
                if not gone:
                    now.row(turn, role, text, fault)
            yield _batch(out, _REPORT)
        if now is not None:
            yield _batch([now.closed()], _REPORT)

    return ordered.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(walk, REPORT)


TURNS = "conv_id long, turn_no long, edit string, role string, text string"
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                    ("text", pa.string())])


def apply_repairs(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """The repaired turns, numbered from 0, with the edit that made each.  Rows
    of one conversation lie together and in order."""
    audits = reports.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
                            F.lit("").alias("text"), "audit")
    stream = (rows.where("not gone").select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit"))
              .unionByName(audits).repartition("conv_id")
              .sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state, number, conv = "", 0, START, 0, None
        for batch in batches:
            out: list[tuple] = []

            def say(letter: str, role: str, text: str) -> None:
                nonlocal number
                out.append((conv, number, letter, role, text))
                number += 1

            def inserts() -> None:
                nonlocal at, state
                while at < len(audit) and audit[at] == "I":
                    at, state = at + 1, _NEXT[state]
                    say("I", _ROLE[state], "")

            for conv, role, text, plan in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "audit"))):
                if plan is not None:
                    audit, at, state, number = plan, 0, START, 0
                    inserts()
                    continue
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = _KEPT[state, role[:1]]
                    say("K", role, text)
                elif letter == "R":
                    state = _NEXT[state]
                    say("R", _ROLE[state], text)
                inserts()
            yield _batch(out, _TURNS)

    return stream.mapInArrow(edit, TURNS)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the sha256 of ``role:text`` lines, of turns as
    ``apply_repairs`` lays them out."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = conv = None
        for batch in batches:
            out = []
            for conv_id, no, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "role", "text"))):
                if no == 0:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = conv_id, hashlib.sha256()
                digest.update((("\n" if no else "") + f"{role}:{text}").encode())
            yield _batch(out, schema)
        if digest is not None:
            yield _batch([(conv, digest.hexdigest())], schema)

    return turns.mapInArrow(read, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, repaired turns) of rows with the columns that ``damage`` gives."""
    reports = stored(plan_repairs(faults(rows)), "repair-reports")
    return reports, apply_repairs(rows, reports)


def repaired_digest(rows: DataFrame) -> DataFrame:
    """A row a conversation: faults, cost, audit, repaired_sha256."""
    reports, turns = repair(rows)
    said = digests(turns).withColumnRenamed("conv_id", "__conv")
    return reports.join(said, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").select(
        *reports.columns, F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
