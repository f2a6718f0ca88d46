"""Repair of conversation structure: a dynamic program that is carried over sorted rows.

Rows are dealt by conversation and sorted by turn (nulls first; equal turns by role and text, copies last), and
one stream over them finds the cheapest edits that turn each conversation into ``(s?(ua)+)?``: an optional
system turn, then pairs of user and assistant. The program has four states (nothing put out yet; last put out
system, user, assistant). For each it carries the least cost, the rank of its edits among those of the other states in
ASCII order, and the running SHA-256 of the repaired text: constant memory, whatever the length, across Arrow batches.

Costs and ranks, taken relative to the least, take few values, so the program is a finite automaton: what a row
does to them is worked out once for each (values, class of row) and looked up from then on. The number of that
transition is the row's backpointer, four bytes. Those of a giant conversation are spilled to an anonymous file
of the task in blocks, which goes with the task, and are read backwards when the conversation ends.

No string of edits that ends with the same row is the beginning of another, so ranks decide every tie exactly.

What moves: each row once, by its conversation. Copies inside a conversation are found by a window whose keys
begin with the conversation, in the same exchange. A conversation is one stream, as its digest and its edits
are: one that holds a third of all rows is read by one task, row by row and in constant memory but for its
own result and the sort, which spills.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches

START, SYSTEM, USER, ASSISTANT = range(4)
#: A state whose cost is further from the least than this can't be on a cheapest path: any state can be left for
#: any other's future by at most two inserted turns and a deleted one (10).
REACH = 12
#: Where each role may be put out, and what follows.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: Backpointers that are held before they are spilled, and bytes of one.
SPILL_ROWS, POINTER = 1 << 20, 4


def put(state: int) -> int:
    """The state after the one turn that may be inserted."""
    return ASSISTANT if state == USER else USER


def edits(initial: str, forced: bool, truncated: bool) -> list[list[tuple[int, str, int]]]:
    """For each state: (cost, letters, next state) of all ways to put turns in and then deal with one row."""
    out: list[list[tuple[int, str, int]]] = []
    for state in range(4):
        own, at = [], state
        for k in range(3):
            own.append((INSERT * k + DELETE, "I" * k + "D", at))
            if not forced:
                worse = INSERT * k + TRUNCATED * truncated
                if at in AFTER.get(initial, {}):
                    own.append((worse + KEEP, "I" * k + "K", AFTER[initial][at]))
                own.append((worse + REROLE, "I" * k + "R", put(at)))
            at = put(at)
        out.append(own)
    return out


class Automaton:
    """The transitions met so far. A vector holds (cost over the least, rank) for each state, None where it is out of reach."""

    def __init__(self) -> None:
        self.edits = {(i, f, t): edits(i, f, t) for i in "sua?" for f in (False, True) for t in (False, True)}
        self.number: dict[tuple, int] = {}
        #: For each transition: next vector, growth of the least cost, and for each state (state before, letters).
        self.steps: list[tuple[tuple, int, tuple]] = []

    def step(self, vector: tuple, kind: tuple[str, bool, bool]) -> int:
        n = self.number.get((vector, kind))
        if n is None:
            n = self.number[vector, kind] = len(self.steps)
            best: list[tuple[int, int, str, int] | None] = [None] * 4
            for before, known in enumerate(vector):
                if known:
                    for cost, letters, after in self.edits[kind][before]:
                        found = (known[0] + cost, known[1], letters, before)
                        if best[after] is None or found < best[after]:
                            best[after] = found
            least = min(b[0] for b in best if b)
            best = [b if b and b[0] - least <= REACH else None for b in best]
            order = sorted(b[1:3] for b in best if b)
            self.steps.append((tuple(b and (b[0] - least, order.index(b[1:3])) for b in best), least, tuple(b and (b[3], b[2]) for b in best)))
        return n


BEGIN: tuple = ((0, 0), None, None, None)


def finish(vector: tuple) -> tuple[int, int, str]:
    """Cost over the least, state and inserted turns of the cheapest end."""
    ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
    cost, _, state = min((known[0] + INSERT * len(ends[s]), known[1], s) for s, known in enumerate(vector) if known)
    return cost, state, ends[state]


def inserted(state: int, n: int) -> tuple[bytes, int]:
    """The text of n inserted turns, each with the line feed before it unless it is the first, and the state after them."""
    out = b""
    for _ in range(n):
        out += b"\n" * (state != START) + NAMES[put(state)] + b":"
        state = put(state)
    return out, state


class Stream:
    """The conversation that is being read."""

    def __init__(self, automaton: Automaton, conv_id: Any) -> None:
        self.automaton, self.conv_id = automaton, conv_id
        self.vector, self.cost = BEGIN, 0
        self.hashes: list = [hashlib.sha256(), None, None, None]
        self.pointers, self.spilled, self.blocks = array("I"), None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.least = self.last = None
        self.turns = 0

    def row(self, turn: int | None, role: bytes, text: bytes, copy: bool) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role.decode()[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        end = text.rstrip()[-1:]  # of ASCII white space
        blank, copy = not end, copy and bool(end)
        truncated = not blank and not copy and end not in b".!?"
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + copy, self.truncated + truncated
        n = self.automaton.step(self.vector, (initial if initial in AFTER else "?", blank or copy, truncated))
        self.vector, grown, ways = self.automaton.steps[n]
        self.cost += grown
        self.pointers.append(n)
        if len(self.pointers) >= SPILL_ROWS:
            self.spilled = self.spilled or tempfile.TemporaryFile()
            self.spilled.write(self.pointers.tobytes())
            self.pointers, self.blocks = array("I"), self.blocks + 1
        self.hashes = [way and self.digest(*way, role, text) for way in ways]

    def digest(self, state: int, letters: str, role: bytes, text: bytes) -> Any:
        """The hash of what state has put out, with the row's edits; hashes are shared, never changed."""
        if letters == "D":
            return self.hashes[state]
        out = self.hashes[state].copy()
        put_in, at = inserted(state, len(letters) - 1)
        out.update(put_in)
        if letters[-1] != "D":
            out.update(b"\n" * (at != START) + (role if letters[-1] == "K" else NAMES[put(at)]) + b":" + text)
        return out

    def audit(self, state: int, end: str) -> str:
        """The letters of the cheapest edits, by the backpointers from the last row to the first."""
        parts = [end]
        for block in range(self.blocks, -1, -1):
            pointers = self.pointers
            if block < self.blocks:
                self.spilled.seek(block * SPILL_ROWS * POINTER)
                pointers = array("I", self.spilled.read(SPILL_ROWS * POINTER))
            letters = []
            for n in reversed(pointers):
                state, own = self.automaton.steps[n][2][state]
                letters.append(own)
            parts.append("".join(reversed(letters)))
        if self.spilled:
            self.spilled.close()
        return "".join(reversed(parts))

    def result(self) -> tuple:
        over, state, end = finish(self.vector)
        digest = self.hashes[state].copy()
        digest.update(inserted(state, len(end))[0])
        gaps = 0 if self.last is None else self.last - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + over, self.audit(state, end), digest.hexdigest()


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def in_order(rows: DataFrame, present: str | None = None) -> tuple[DataFrame, list[Column]]:
    """conv_id, turn, role, text (nulls of the last two: one space), here and copy of each row, and what sorts a conversation.

    here: the row is there, and doesn't only name its conversation. copy: role and text stand earlier in it.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), (F.col(present) if present else F.lit(True)).alias("here"))
    same = Window.partitionBy("conv_id", "here", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    out = out.repartition("conv_id").withColumn("copy", F.row_number().over(same) > 1)
    return out, [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("copy")]


def repair(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row for each conv_id: its faults and gaps, and the cheapest edits that repair it.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (letters of the edits: Delete, Insert, Keep,
    Rerole) and repaired_sha256 (of the repaired ``role:text``, joined by line feeds). present: a boolean column;
    rows where it is false or null only name their conversation, which then has a row of zeros if no other row is there.

    A null conv_id is a conversation of its own. Null roles and texts count as one space, so such a text is blank;
    a null turn comes first and opens no gap. Equal rows are copies of the first. Rows of one turn stand in the order of
    role and text. An empty table gives no rows; other columns play no part. Texts are never cut.
    """
    ordered, keys = in_order(rows, present)
    ready = ordered.sortWithinPartitions(*keys).select("conv_id", "turn", F.col("role").cast("binary"), F.col("text").cast("binary"), "here", "copy")
    names = [x.split()[0] for x in ("conv_id, " + FIELDS).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        automaton, stream, done = Automaton(), None, []
        for batch in batches:
            ids, turns, roles, texts, here, copies = (batch.column(k) for k in range(6))
            for k, (conv_id, turn, there, copy) in enumerate(zip(ids.to_pylist(), turns.to_pylist(), here.to_pylist(), copies.to_pylist())):
                if stream is None or stream.conv_id != conv_id:
                    if stream:
                        done.append(stream.result())
                    stream = Stream(automaton, conv_id)
                if there:
                    stream.row(turn, roles[k].as_py(), texts[k].as_py(), copy)
            if done:
                yield dict(zip(names, zip(*done)))
                done = []
        if stream:
            yield dict(zip(names, zip(*[stream.result()])))

    return map_batches(ready, run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {FIELDS}")


def repaired_turns(rows: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 1), role, text, edit (K, R or I) and turn of the row it comes from (null: none).

    Nulls and ties as in ``repair``. A conversation that is emptied has no rows here.
    """
    ordered, keys = in_order(rows, present)
    numbered = ordered.filter("here").withColumn("row_no", F.row_number().over(Window.partitionBy("conv_id").orderBy(*keys[1:])))
    steps = repair(rows, present).select(F.col("conv_id").alias("of"), F.posexplode(F.split("audit", "")).alias("step", "edit")).filter("edit <> ''")
    so_far = Window.partitionBy("of").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = steps.withColumn("at", F.sum((F.col("edit") != "I").cast("long")).over(so_far)).withColumn("position", F.sum((F.col("edit") != "D").cast("long")).over(so_far))
    mine = F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("row_no")) & (F.col("edit") != "I")
    put_out = steps.filter("edit <> 'D'").join(numbered, mine, "left")
    system = F.max((F.col("edit") == "K") & F.col("role").startswith("s") & (F.col("position") == 1)).over(Window.partitionBy("of")).cast("int")
    named = F.when((F.col("position") - system) % 2 == 1, "user").otherwise("assistant")
    out = put_out.withColumn("named", named)
    return out.select(F.col("of").alias("conv_id"), "position", F.when(F.col("edit") == "K", F.col("role")).otherwise(F.col("named")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit", "turn")


def damage(rows: DataFrame) -> DataFrame:
    """Rows with the faults of the contract, by ``crc32(conv_id:turn) % 20``, and ``present``, false for a dropped row.

    0 drops the row, 1 empties its text, 2 takes away its ``.!?``, 3 repeats it, 4 makes its role user. Null values count
    as one space, but the turn stays null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind != 0).alias("present"), F.explode(times).alias("copy_no")).drop("copy_no")
