"""Repair of conversation structure by iterative-deepening A*.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Each of its rows may be kept, given another
role, or deleted, and rows without text may be inserted. The cheapest edits are found by a depth-first search that tries edits in
ASCII order under a bound on cost plus what the rest costs at least; the bound grows to the least sum that went beyond it.
A table remembers with how much budget a state failed, so it is not entered again with as much or less. The first path
that a sufficient bound accepts is the ASCII-least of the cheapest ones.

Faults are found by column functions, duplicates by a window over one text of one conversation. Rows then stream in order
through a task; a conversation of more than ``SEGMENT`` rows is searched by segments, from every state to every state, of which
the best combination is kept as it goes. So a task holds a segment and the edits of one conversation, whatever its
length. The repaired text is only hashed or passed on, not gathered. One conversation's rows do pass one task, as a stream: a
hash over all of its text has no other way.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleflow.llm.common import small_batches

#: Rows that are searched at once.
SEGMENT = 48
DELETE, INSERT, RELABEL, TRUNCATED = 2, 5, 1, 5
FINE, BLANK, DUPLICATE, CUT = range(4)
#: What precedes: nothing, a system row, a user row, an assistant row. Nothing or an assistant row may come last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The row that an insertion or another role makes in each state.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_SPACE = " \t\n\v\f\r"
#: What it costs at most to go on from the first state as from the second: inserted rows, or a system row deleted.
_OVER = {
    (START, SYSTEM): 0, (START, USER): INSERT, (START, ASSISTANT): 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, START): INSERT + DELETE, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT,
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
}


def _kept(state: int, initial: str) -> int | None:
    """The state after a kept row, None where it cannot be kept."""
    if state == START and initial == "s":
        return SYSTEM
    after = _NEXT[state]
    return after if initial == _ROLE[after][0] else None


def cheapest(rows: list[tuple[str, int]], start: int = START, goals: frozenset[int] = frozenset((START, ASSISTANT))) -> tuple[int, str] | None:
    """Cost and edits of the cheapest way through rows of ``(role initial, fault)`` from ``start`` to one of the goals; of equally
    cheap ones the ASCII-least. None where there is none."""
    n = len(rows)
    if goals == {SYSTEM} and start == START and not any(r == "s" and f not in (BLANK, DUPLICATE) for r, f in rows):
        return None
    if goals <= {START, SYSTEM} and not (start == START or start in goals):
        return None
    # what the rows from each position on cost at least; a system row is free once at most, and only at the start
    rest, free = [0] * (n + 1), [False] * (n + 1)
    for k in range(n - 1, -1, -1):
        initial, fault = rows[k]
        least = DELETE if fault != FINE else 0 if initial in "ua" and initial else RELABEL
        rest[k] = rest[k + 1] + least
        free[k] = free[k + 1] or (initial == "s" and fault == FINE)

    def least(at: int, state: int) -> int:
        return rest[at] - (RELABEL if state == START and free[at] else 0)

    def steps(at: int, state: int) -> list[tuple[str, int, int, int]]:
        """Edits in ASCII order: initial, cost, position and state after it."""
        out = []
        after = _NEXT[state]
        if at < n:
            out.append(("D", DELETE, at + 1, state))
        out.append(("I", INSERT, at, after))
        if at < n:
            initial, fault = rows[at]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                kept = _kept(state, initial)
                if kept is not None:
                    out.append(("K", more, at + 1, kept))
                out.append(("R", RELABEL + more, at + 1, after))
        return out

    bound = least(0, start)
    while True:
        failed: dict[tuple[int, int], int] = {}
        beyond = None
        # one entry per state on the path: its position, state, cost so far, and the edits still to try
        path = [(0, start, 0, iter(steps(0, start)))]
        edits: list[str] = []
        if n == 0 and start in goals:
            return 0, ""
        while path:
            at, state, spent, todo = path[-1]
            for edit, cost, after, new in todo:
                total = spent + cost + least(after, new)
                if total > bound:
                    beyond = total if beyond is None else min(beyond, total)
                elif after == n and new in goals:
                    return spent + cost, "".join(edits) + edit
                elif failed.get((after, new), -1) < bound - spent - cost:
                    edits.append(edit)
                    path.append((after, new, spent + cost, iter(steps(after, new))))
                    break
            else:
                failed[at, state] = max(failed.get((at, state), -1), bound - spent)
                path.pop()
                if edits:
                    edits.pop()
        bound = beyond


def repaired(rows: list[tuple[str, str]], edits: str, state: int = START) -> Iterator[tuple[str, str]]:
    """Role and text of the rows that the edits leave, for the rows they start at in ``state``."""
    at = iter(rows)
    for edit in edits:
        if edit == "I":
            state = _NEXT[state]
            yield _ROLE[state], ""
            continue
        role, text = next(at)
        if edit == "K":
            state = _kept(state, role[:1])
            yield role, text
        elif edit == "R":
            state = _NEXT[state]
            yield _ROLE[state], text


@dataclass
class _Way:
    """The best way to a state: its cost, those of its edits that are not common to all ways, and the hash of its rows."""

    cost: int = 0
    edits: str = ""
    digest: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    empty: bool = True

    def followed(self, cost: int, edits: str, rows: list[tuple[str, str]], state: int) -> "_Way":
        digest, empty = self.digest.copy(), self.empty
        for role, text in repaired(rows, edits, state):
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        return _Way(self.cost + cost, self.edits + edits, digest, empty)


class Conversation:
    """Takes the rows of one conversation in order, and keeps no more of them than a segment."""

    def __init__(self) -> None:
        self.faults = [0, 0, 0, 0]
        self.turns, self.first, self.last = 0, None, None
        self.illegal, self.initial = 0, None
        self.rows: list[tuple[str, str, int]] = []
        self.ways = {START: _Way()}
        self.done: list[str] = []

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if len(self.rows) == SEGMENT:
            self._search([frozenset((s,)) for s in (START, SYSTEM, USER, ASSISTANT)])
        self.rows.append((role, text, fault))

    def _search(self, goals: list[frozenset[int]]) -> None:
        symbols, rows = [(r[:1], f) for r, _, f in self.rows], [(r, t) for r, t, _ in self.rows]
        ways = {}
        for goal in goals:
            best = None
            for state, way in self.ways.items():
                found = cheapest(symbols, state, goal)
                if found and (best is None or (way.cost + found[0], way.edits + found[1]) < best[:2]):
                    best = way.cost + found[0], way.edits + found[1], state, found
            if best:
                ways[min(goal)] = self.ways[best[2]].followed(*best[3], rows, best[2])
        # ways that can no longer be the cheapest would keep the others from agreeing
        ways = {s: w for s, w in ways.items() if not any(o.cost + _OVER.get((t, s), w.cost) < w.cost for t, o in ways.items())}
        common = os.path.commonprefix([w.edits for w in ways.values()])
        self.done.append(common)
        for way in ways.values():
            way.edits = way.edits[len(common):]
        self.ways, self.rows = ways, []

    def result(self) -> tuple:
        """``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
        self._search([frozenset((START, ASSISTANT))])
        (way,) = self.ways.values()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        _, blank, duplicate, cut = self.faults
        return gaps, blank, duplicate, cut, self.illegal, way.cost, "".join(self.done) + way.edits, way.digest.hexdigest()


def faults(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, fault`` of every row; a null role or text counts as one space. ``fault``: 0 none, 1 blank,
    2 duplicate (role and text seen earlier in the conversation), 3 truncated. Rows of one turn come by role, then by text."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`"), F.lit(" "))

    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    shown = F.rtrim("text", F.lit(_SPACE))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).orderBy("turn"))
    rows = rows.withColumn("seen", seen)
    fault = (F.when(shown == "", BLANK).when(F.col("seen") > 1, DUPLICATE)
             .when(F.right(shown, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT))
    return rows.withColumn("fault", fault).drop("seen")


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation in one task, its rows as they are taken."""
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, "turn", "role", "text", "fault")


def repair(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None
) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``gaps``: turns missing between the first and the last one; ``blank``, ``duplicate``, ``truncated``: rows by their first
    fault; ``illegal``: adjacent rows whose role initials are not su, ua or au; ``cost`` and ``audit``: of the cheapest edits (K keep,
    R give another role, D delete, I insert); ``repaired_sha256``: of the lines ``role:text`` that they leave.

    Rows go by turn, null turns first, then by role and text; a null role or text counts as one space, a null id is a
    conversation of its own, repeated rows are duplicates. ``present``: a condition on ``df``; rows where it does not hold only
    name their conversation, which has zeros and no edits if it has no others. An empty table gives an empty one; other columns
    are not read.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    found = faults(df.where(there), id_col, turn_col, role_col, text_col)
    if present is not None:
        named = df.where(~there).select(F.col(f"`{id_col}`").alias("conv_id")).distinct()
        found = found.unionByName(named, allowMissingColumns=True)
    kind = dict(found.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *(part.split()[0] for part in RESULT.split(", "))]
        key, own, out = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array([r[k] for r in out], id_type if k == 0 else None) for k in range(len(names))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            id_type = batch["conv_id"].type
            for conversation, turn, role, text, fault in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if own is None or conversation != key:
                    if own is not None:
                        out.append((key, *own.result()))
                    key, own = conversation, Conversation()
                if fault is not None:
                    own.add(turn, role, text, fault)
            if len(out) > 1000:
                yield flushed()
        if own is not None:
            out.append((key, *own.result()))
            yield flushed()

    return _in_order(found).mapInArrow(run, f"conv_id {kind}, {RESULT}")


def rewritten(
    df: DataFrame, edits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The rows of the repaired conversations: ``conv_id, position`` (from 0)``, role, text``.

    ``edits``: ``conv_id, audit`` as ``repair`` returned them for ``df``. Conversations whose audit is missing are left out.
    """
    found = faults(df, id_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    heads = edits.select("conv_id", "audit").dropDuplicates(["conv_id"])
    kind = dict(found.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, audit, at, position = None, START, None, 0, 0
        for batch in batches:
            out: list[tuple] = []

            def emit(row: tuple[str, str], edit: str) -> None:
                nonlocal state, position
                for role, text in repaired([row], edit, state):
                    out.append((key, position, role, text))
                    position += 1
                if edit in "IR":
                    state = _NEXT[state]
                elif edit == "K":
                    state = _kept(state, row[0][:1])

            columns = (batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text", "fault"))
            for conversation, edit, role, text, fault in zip(*columns):
                if edit is not None:  # the head of the next conversation
                    while audit and at < len(audit):
                        emit(("", ""), "I")
                        at += 1
                    key, state, audit, at, position = conversation, START, edit, 0, 0
                elif audit is not None and conversation == key:
                    while audit[at] == "I":
                        emit(("", ""), "I")
                        at += 1
                    emit((role, text), audit[at])
                    at += 1
            id_type = batch["conv_id"].type
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((id_type, pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "role", "text"])
        last = [(key, position + k, *row) for k, row in enumerate(repaired([], audit[at:], state))] if audit else []
        if last:
            columns = [pa.array([r[k] for r in last], t) for k, t in enumerate((id_type, pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "role", "text"])

    rows = found.unionByName(heads, allowMissingColumns=True).withColumn("row", F.col("audit").isNull())
    return _in_order(rows, "row").mapInArrow(run, f"conv_id {kind}, position bigint, role string, text string")


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Column]:
    """``conv_id, turn, role, text, harm`` with known damage, and the condition that a row is still there.

    By CRC-32 of ``id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role
    ``user``. Nulls are one space here, in texts and roles too.
    """
    def filled(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    harm = (F.crc32(F.concat(filled(id_col), F.lit(":"), filled(turn_col)).cast("binary")) % 20).cast("int")
    rows = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"), harm.alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))})
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.withColumn("copy", copies).drop("copy"), F.col("harm") != 0
