"""Conversation structure repair (operator 13).

A conversation should read as an optional system turn and then user and assistant in turn. Rows are kept, given another role,
deleted, or new ones are inserted, at least cost. Backward over a conversation's rows goes the cost of the cheapest repair from
each place and grammar state to the end; forward, from the start, goes the walk that takes the ASCII-least edit among those
that keep to that cost.

Both passes take rows as a sorted stream, one after the other, and hold four numbers or one state, so that memory doesn't grow
with a conversation. One shuffle brings a conversation's rows to one task. A digest of the whole repaired conversation can only
be taken in order, so that one task must read it all in any case; what it holds stays the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Costs of edits, and of leaving a truncated row in.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Grammar states: nothing yet, after a system turn, after a user's, after an assistant's. What is asked for next in each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEVER = 1 << 60
#: Adjacent role initials that are no fault.
LEGAL = ("su", "ua", "au")
#: Rows of an output batch.
ROWS = 4_096

_SOLID = r"[^\x20\x09-\x0D]"
#: Faults of a row; the first that applies counts.
SOUND, BLANK, REPEATED, CUT = range(4)


def follows(state: int, initial: str) -> int | None:
    """The state after a turn with this initial; None if the grammar has no such turn here."""
    return AFTER[initial] if initial == NEXT[state] or (state == START and initial == "s") else None


def backward(fault: int, initial: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to the end from before a row, by state; after: the costs from behind it."""
    cost = []
    for state in range(4):
        best = DELETE + after[state]
        if fault in (SOUND, CUT):
            left_in = TRUNCATED if fault == CUT else 0
            best = min(best, RENAME + left_in + after[AFTER[NEXT[state]]])
            to = follows(state, initial)
            if to is not None:
                best = min(best, left_in + after[to])
        cost.append(best)
    return inserted(cost)


def inserted(cost: list[int]) -> tuple[int, ...]:
    """cost, where turns may be inserted first. After two insertions the state is one that was there before."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[AFTER[NEXT[state]]]) for state, c in enumerate(cost)]
    return tuple(cost)


#: Costs behind the last row: it may end before any turn and after an assistant's.
END = inserted([0, NEVER, NEVER, 0])


def forward(fault: int, initial: str, state: int, before: tuple[int, ...], after: tuple[int, ...]) -> tuple[str, str, int]:
    """(edit, initial of the turn that it leaves, next state): the ASCII-least edit that keeps to the cost `before`. An edit
    I leaves the row for the next step. D comes before I, I before K, K before R."""
    if before[state] == DELETE + after[state]:
        return "D", "", state
    wanted = NEXT[state]
    if before[state] == INSERT + before[AFTER[wanted]]:
        return "I", wanted, AFTER[wanted]
    left_in = TRUNCATED if fault == CUT else 0
    to = follows(state, initial)
    if fault in (SOUND, CUT) and to is not None and before[state] == left_in + after[to]:
        return "K", initial, to
    return "R", wanted, AFTER[wanted]


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """rows as (conv, turn, role, text, copy, gone), damaged by a hash of conversation and turn: 0 of 20 are gone, 1 lose their
    text, 2 its sentence ends, 3 stand twice, 4 are the user's. Null roles and texts, and nulls in what is hashed, are a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    rows = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone"))


def fault() -> Column:
    """A row's first fault, of columns text and seen."""
    return F.when(~F.col("text").rlike(_SOLID), BLANK).when(F.col("seen"), REPEATED).when(F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), CUT).otherwise(SOUND)


def edits(rows: DataFrame) -> DataFrame:
    """The cheapest edits of rows (conv, turn, role, text, gone): one row for each, as (conv, place, edit, role, text, turn,
    row_role, fault, gone). role and text: of the turn that the edit leaves; row_role: the role before it.

    A conversation's rows stand together and in order, within one partition. Rows are ordered by turn (nulls first), then role
    and text. A null conversation is one of its own. Rows that are `gone` are passed over, so that conversations without any
    other row still have one here, whose edit is null. Empty input gives no rows.
    """
    spark: SparkSession = rows.sparkSession
    Scratch(spark)
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    # the one shuffle: what follows needs a conversation's rows in one partition only
    rows = rows.repartition("conv")
    first = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    rows = rows.withColumn("seen", F.row_number().over(first) > 1)
    rows = rows.select("conv", "turn", "role", "text", "copy", "gone", fault().alias("fault"), F.substring("role", 1, 1).alias("initial"))
    conv = rows.schema["conv"].dataType.simpleString()
    order = lambda up: [F.col("conv"), *[(F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last()) for c in ("turn", "role", "text", "copy")]]
    costed = rows.sortWithinPartitions(*order(False)).mapInArrow(_backward, f"conv {conv}, turn long, role string, text string, copy int, gone boolean, fault int, initial string, before array<bigint>, after array<bigint>")
    walked = costed.sortWithinPartitions(*order(True)).mapInArrow(_forward, f"conv {conv}, place long, edit string, role string, text string, turn long, row_role string, fault int, gone boolean")
    return walked


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation, last first, with the costs to the end from before and from behind each."""
    at, cost, any_yet = None, END, False
    costs = pa.list_(pa.int64())
    for batch in batches:
        before, after = [], []
        for conv, gone, flaw, initial in zip(*(batch.column(c).to_pylist() for c in ("conv", "gone", "fault", "initial"))):
            if not any_yet or conv != at:
                at, cost, any_yet = conv, END, True
            after.append(cost)
            if not gone:
                cost = backward(flaw, initial, cost)
            before.append(cost)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, costs), pa.array(after, costs)], names=[*batch.schema.names, "before", "after"])


class _Edits:
    """Output rows, given away in batches."""

    def __init__(self, conv: pa.DataType):
        self.types = {"conv": conv, "place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string(), "turn": pa.int64(), "row_role": pa.string(), "fault": pa.int32(), "gone": pa.bool_()}
        self.rows: list[tuple] = []

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.types)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types.values())], names=list(self.types))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk over each conversation, first row first. Turns inserted at the end follow when the next conversation begins."""
    at, state, place, out, open_yet = None, START, 0, None, False

    def ending() -> None:
        nonlocal state, place
        while state not in (START, ASSISTANT):
            wanted = NEXT[state]
            out.rows.append((at, place, "I", ROLES[wanted], "", None, None, None, False))
            state, place = AFTER[wanted], place + 1

    for batch in batches:
        out = out or _Edits(batch.column(0).type)
        for conv, turn, role, text, _, gone, flaw, initial, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            if not open_yet or conv != at:
                if open_yet:
                    ending()
                at, state, place, open_yet = conv, START, 0, True
            if gone:
                out.rows.append((conv, place, None, None, None, turn, None, None, True))
                continue
            edit = "I"
            while edit == "I":
                edit, left, state = forward(flaw, initial, state, before, after)
                new_role = None if edit == "D" else role if edit == "K" else ROLES[left]
                inserted_here = edit == "I"
                out.rows.append((conv, place, edit, new_role, None if edit == "D" else "" if inserted_here else text, None if inserted_here else turn, None if inserted_here else role, None if inserted_here else flaw, False))
                place += 1
            if len(out.rows) >= ROWS:
                yield out.batch()
    if out:
        if open_yet:
            ending()
        yield out.batch()


def repaired(found: DataFrame) -> DataFrame:
    """The repaired conversations (conv, turn, role, text) from edits(): what is left, with turns counted anew from 0."""
    left = found.where(F.col("edit").isNotNull() & (F.col("edit") != "D"))
    return left.select("conv", (F.row_number().over(Window.partitionBy("conv").orderBy("place")) - 1).cast("long").alias("turn"), "role", "text")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(found: DataFrame) -> DataFrame:
    """One row for each conversation of edits(), taken as the stream that it is: REPORT, audit (the edits' letters) and
    repaired_sha256 (of `role:text`, joined by newlines)."""
    conv = found.schema["conv"].dataType.simpleString()
    return found.mapInArrow(_report, f"conv {conv}, {', '.join(f'{c} long' for c in REPORT)}, audit string, repaired_sha256 string")


class _Tally:
    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.left, self.last = conv, bytearray(), hashlib.sha256(), 0, None
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0

    def add(self, edit, role, text, turn, row_role, flaw) -> None:
        if row_role is not None:
            self.faults[flaw] += 1
            if self.last is not None and self.last + row_role[:1] not in LEGAL:
                self.illegal += 1
            self.last = row_role[:1]
            if turn is not None and turn != self.turn:
                self.turns, self.turn, self.high = self.turns + 1, turn, turn
                self.low = turn if self.low is None else self.low
        self.audit += edit.encode()
        self.cost += {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if edit in "KR" and flaw == CUT else 0)
        if edit != "D":
            self.sha.update(f"{chr(10) if self.left else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.left += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.faults[BLANK], self.faults[REPEATED], self.faults[CUT], self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, kind = None, None

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv", *REPORT, "audit", "repaired_sha256"])

    for b in batches:
        kind, rows = b.column(0).type, []
        for conv, _, edit, role, text, turn, row_role, flaw, gone in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or conv != now.conv:
                if now is not None:
                    rows.append(now.row())
                now = _Tally(conv)
            if not gone:
                now.add(edit, role, text, turn, row_role, flaw)
        yield batch(rows)
    if now is not None:
        yield batch([now.row()])


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(edits(damage(table(spark, sf_dir, "conversations")))).withColumnRenamed("conv", "conv_id")
