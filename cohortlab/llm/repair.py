"""Conversation structure repair by least-cost edits and prefix-doubling path ranking.

Rows of a conversation are kept, re-roled, deleted, and empty rows inserted, so that the
initials of the roles read ``(s?(ua)+)?`` at the least cost. A node is (rows done, state of
that expression); a backward pass gives each node's cost, and the arcs on cheapest paths are
the optimal arcs. Among the cheapest audits (the edits' initials) the ASCII-least is found by
doubling: nodes are ranked by the first 1, 2, 4, ... initials of their least audit, a rank of
twice the length being that of the pair (own rank, rank of the node that far on). The doubled
pointers then lay the path out from its start, twice as many nodes a step.

Conversations are shuffled by id and sorted; a task takes some thousand at a time and ranks
them together. One conversation is one value: its rows, and the repaired ones, are held by
the task that repairs it.

Defined cases: a null role or text is one space (blank, or of no legal initial); an empty role
has no initial, so its row cannot be kept; rows go by turn (nulls first), then role and text;
rows of the null conversation id are a conversation; other columns are ignored; an empty table
gives an empty result; a conversation without rows has zeros and an empty audit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # costs
MARKS = b"DIKR"  # edits in ASCII order
D, I, K, R = range(4)
# states: nothing yet, after s, after u, after a; only the first and the last may end
START, AFTER_S, AFTER_U, AFTER_A = range(4)
DUE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)  # the state after the role that is due
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60
SPACES = " \t\n\x0b\x0c\r"
BATCH_ROWS = 50_000
MOST_TEXT = 64 << 20

RESULT = "turns array<struct<role string, text string>>"
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
          f"audit string, {RESULT}")


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with planted faults, by crc32 of ``conv_id:turn``
    modulo 20 (a null is one space): 0 drops a row, 1 empties its text, 2 removes its marks
    ``.!?``, 3 repeats it, 4 makes it a user row."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    fate = F.crc32(F.concat_ws(":", part("conv_id"), part("turn"))) % 20
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    times = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(part("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def _steps(role: str, must_go: bool, truncated: bool) -> list[list[tuple[int, int, int]]]:
    """For each state the (edit, cost, next state) of a row, in the edits' order."""
    more = TRUNCATED if truncated else 0
    out = []
    for state in range(4):
        arcs = [(D, DELETE, state)]
        if not must_go:
            if role[:1] == "s" and state == START:
                arcs.append((K, KEEP + more, AFTER_S))
            elif role[:1] in ("u", "a") and DUE[state] == (AFTER_U if role[0] == "u" else AFTER_A):
                arcs.append((K, KEEP + more, DUE[state]))
            arcs.append((R, REROLE + more, DUE[state]))
        out.append(arcs)
    return out


_KINDS: dict[tuple, list] = {}


def steps_of(role: str, must_go: bool, truncated: bool) -> list:
    key = (role[:1] if role[:1] in ("s", "u", "a") else "", must_go, truncated)
    if key not in _KINDS:
        _KINDS[key] = _steps(*key)
    return _KINDS[key]


def settle(cost: list[int]) -> list[int]:
    """Costs of the four states once rows may be inserted."""
    u = min(cost[AFTER_U], cost[AFTER_A] + INSERT)
    return [min(cost[START], u + INSERT), min(cost[AFTER_S], u + INSERT), u, min(cost[AFTER_A], u + INSERT)]


def optimal_arcs(kinds: list[list]) -> tuple[int, np.ndarray, np.ndarray]:
    """(cost, edit, next node) of a conversation; node 4 i + state. Each node's row lists its
    optimal arc's edit for every edit in order (-1: not optimal). The last node is the end."""
    n = len(kinds)
    end = 4 * (n + 1)
    edit = np.full((end + 1, 4), 127, np.int8)
    step = np.full((end + 1, 4), end, np.int64)
    after = settle([0, FAR, FAR, 0])
    for state, ahead in ((START, None), (AFTER_S, AFTER_U), (AFTER_U, AFTER_A), (AFTER_A, None)):
        if ahead is not None:
            edit[4 * n + state, I], step[4 * n + state, I] = I, 4 * n + ahead
    for i in range(n - 1, -1, -1):
        arcs, ahead = kinds[i], 4 * (i + 1)
        own = [min(c + after[to] for _, c, to in arcs[s]) for s in range(4)]
        now = settle(own)
        for s in range(4):
            at = 4 * i + s
            if now[s] == own[s]:
                for e, c, to in arcs[s]:
                    if c + after[to] == now[s]:
                        edit[at, e], step[at, e] = e, ahead + to
            if now[s] == now[DUE[s]] + INSERT:
                edit[at, I], step[at, I] = I, 4 * i + DUE[s]
        after = now
    return after[START], edit, step


def least_paths(edit: np.ndarray, step: np.ndarray, starts: np.ndarray, longest: int) -> np.ndarray:
    """The nodes of the ASCII-least optimal path from each start (rows; the end repeats).

    ``edit`` and ``step`` hold the optimal arcs of all conversations together. The end's rank
    is lowest, so a path that stops ranks before one that goes on."""
    node = np.arange(len(edit))
    ends = (edit == 127).all(axis=1)
    choice = edit.argmin(axis=1)  # edits of a node's arcs differ: the first rank decides
    rank = np.where(ends, 0, edit[node, choice].astype(np.int64) + 1)
    jump = np.where(ends, node, step[node, choice])
    path, length = starts.reshape(-1, 1), 1
    while length <= longest:
        path = np.concatenate((path, jump[path]), axis=1)
        pair = rank * (len(node) + 1) + rank[jump]
        rank = np.unique(pair, return_inverse=True)[1]
        jump, length = jump[jump], 2 * length
    return path


class Conversation:
    """One conversation's rows in order: their faults, and what its repair gives."""

    def __init__(self, conv_id):
        self.id, self.rows, self.turns, self.size = conv_id, [], [], 0

    def add(self, turn, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.turns.append(turn)
        self.size += len(text)

    def inspect(self) -> None:
        self.faults, self.kinds, seen = [0, 0, 0], [], set()
        for role, text in self.rows:
            last = text.rstrip(SPACES)[-1:]
            cut = False
            if not last:
                bad = 0
            elif (role, text) in seen:
                bad = 1
            else:
                cut = last not in ".!?"
                bad = 2 if cut else None
            if bad is not None:
                self.faults[bad] += 1
            seen.add((role, text))
            self.kinds.append(steps_of(role, bad in (0, 1), cut))
        known = [t for t in self.turns if t is not None]
        self.gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        first = [r[:1] for r, _ in self.rows]
        self.illegal = sum(a + b not in LEGAL for a, b in zip(first, first[1:]))

    def apply(self, marks: str, states: list[int]) -> list[dict]:
        out, at = [], 0
        for mark, state in zip(marks, states):
            if mark == "I":
                out.append({"role": ROLE[state], "text": ""})
                continue
            role, text = self.rows[at]
            at += 1
            if mark != "D":
                out.append({"role": ROLE[state] if mark == "R" else role, "text": text})
        return out


def repair_batch(convs: list[Conversation]) -> list[tuple]:
    """The result row of each conversation."""
    out = []
    for c in convs:
        c.inspect()
    by_length: dict[int, list[Conversation]] = {}
    for c in convs:
        by_length.setdefault(len(c.rows).bit_length(), []).append(c)
    for same in by_length.values():
        costs, edits, steps, starts, at = [], [], [], [], 0
        for c in same:
            cost, edit, step = optimal_arcs(c.kinds)
            costs.append(cost)
            edits.append(edit)
            steps.append(step + at)
            starts.append(at)
            at += len(edit)
        edit, step = np.concatenate(edits), np.concatenate(steps)
        paths = least_paths(edit, step, np.array(starts), max(2 * len(c.rows) + 2 for c in same))
        least = edit.min(axis=1)
        for c, cost, start, path in zip(same, costs, starts, paths):
            marks = least[path]
            n = int((marks == 127).argmax())
            audit = bytes(MARKS[m] for m in marks[:n].tolist()).decode()
            states = ((path[1:n + 1] - start) % 4).tolist()
            out.append((c.id, c.gaps, *c.faults, c.illegal, cost, audit, c.apply(audit, states)))
    return out


def repair_conversations(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """For each conversation of ``rows`` (conv_id, turn, role, text), and each of ``ids``
    (conv_id) without rows: gaps in its turns, rows by first fault, illegal neighbours, the
    cost and audit of its repair, and the repaired ``turns``."""
    types = pa.struct([("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Conversation] = []
        n = size = 0

        def answer() -> pa.RecordBatch:
            cols = list(zip(*repair_batch(held)))
            kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(types)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[
                "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])

        for batch in batches:
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if not held or held[-1].id != conv:
                    if n > BATCH_ROWS or size > MOST_TEXT:
                        yield answer()
                        held, n, size = [], 0, 0
                    held.append(Conversation(conv))
                if role is not None:  # else: an id without rows
                    held[-1].add(turn, role, text)
                n, size = n + 1, size + len(text or "")
        if held:
            yield answer()

    ship(rows.sparkSession)
    conv = F.col("conv_id").cast("long").alias("conv_id")
    space = F.lit(" ")
    cols = rows.select(conv, F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"))
    if ids is not None:
        cols = cols.unionByName(ids.select(conv).distinct().select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
            F.lit(None).cast("string").alias("text")))
    # nulls come first: the row of an id, then rows without a turn
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)
