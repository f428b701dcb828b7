"""Minimum-cost repair of chat roles, and rendering of the repaired conversation.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, from a user turn to an assistant turn.  A turn can be kept, given
another role, merged into the turn before it (of the same role), and empty turns
can be put in before it or at the end, each at a cost.  The automaton's state is
the role of the last turn, so a turn is a 4 x 4 matrix of least costs, and a run
of turns is the product of its matrices in the (min, +) semiring.  Of repairs of
equal cost those with fewer turns win; of these the one whose turns' new roles have
the least sum of numbers that a hash of turn, role and text gives them.  So the
choice is a function of the turns, wherever a conversation is cut.

Turns are sorted by conversation, turn, role and text over range partitions, so a
conversation of any size is spread over tasks.  A task first returns the matrices
of the conversations at its two ends; those of one conversation, a row for each task
that it spans, are composed in a group; then each task meets the states at its ends
and traces its turns' repairs back from them.  The driver gets nothing.

The result has a row for each turn, and a conversation's rendering is its rows'
fragments in a row, so no task holds a conversation as one string.  Null
conversation ids form one conversation, null turns come first, a null text is
empty, a null or unknown role must be changed.  Repeated rows are turns too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_key, partitions, pieces_of, table

NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
CODES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
MERGE, INSERT, RELABEL, NAME = 1, 3, 2, 1  # NAME: give an unknown role one
FOLLOWS = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
UNIT = 1 << 32  # costs above, counts of turns below
TIE, SHARE = 64, 21  # bits of the sums that settle ties, below both; and of one turn's number for a role
NEVER = 1 << 61 + TIE
START = [0, NEVER, NEVER, NEVER]
#: Bytes of text that a task holds.
PART = 64 << 20
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"


def _steps(code: int) -> list[list[tuple[int, str, tuple[int, ...]]]]:
    """For a turn of role ``code``, from each state to each: weight, action, roles of the empty turns put in before."""
    table_ = [[(NEVER, "", ()) for _ in range(4)] for _ in range(4)]
    for before in range(4):
        for role in (SYSTEM, USER, ASSISTANT):
            change = 0 if role == code else NAME if code == NONE else RELABEL
            label = "keep" if role == code else "relabel"
            ways = []
            if before == role:
                ways.append(((MERGE + change) * UNIT, "merge" if role == code else "relabel+merge", ()))
            if role in FOLLOWS[before]:
                ways.append((change * UNIT + 1, label, ()))
            else:
                for x in FOLLOWS[before]:
                    if role in FOLLOWS[x] and x != SYSTEM:
                        ways.append(((INSERT + change) * UNIT + 2, label, (x,)))
            if ways:
                table_[before][role] = min(ways)
    return table_


STEPS = [_steps(code) for code in range(4)]
WEIGHTS = [[[w << TIE if w < NEVER else NEVER for w, _, _ in row] for row in m] for m in STEPS]
#: What a conversation that ends in a state still needs.
TAILS = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def settle(tie: int) -> list[int]:
    """A turn's numbers for each state after it."""
    return [0, *(tie >> SHARE * k & (1 << SHARE) - 1 for k in range(3))]


def after(vector: list[int], code: int, tie: int) -> list[int]:
    w, more = WEIGHTS[code], settle(tie)
    return [min(NEVER, *(vector[s] + w[s][t] for s in range(4))) + more[t] for t in range(4)]


def through(vector: list[int], matrix: list[list[int]]) -> list[int]:
    return [min(NEVER, *(vector[s] + matrix[s][t] for s in range(4))) for t in range(4)]


def matrix(turns: list[tuple[int, int]]) -> list[list[int]]:
    rows = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]
    for code, tie in turns:
        rows = [after(v, code, tie) for v in rows]
    return rows


def last_state(vector: list[int]) -> int:
    return min(range(4), key=lambda s: vector[s] + (len(TAILS[s]) * (INSERT * UNIT + 1) << TIE))


def trace(turns: list[tuple[int, int]], vector: list[int], end: int | None) -> list[int]:
    """States after each turn of the best repair that begins with ``vector`` and ends in ``end`` (None: in the best state); first the one before."""
    vectors = [vector]
    for code, tie in turns:
        vectors.append(after(vectors[-1], code, tie))
    states = [last_state(vectors[-1]) if end is None else end]
    for (code, _), before in zip(reversed(turns), reversed(vectors[:-1]), strict=True):
        w, t = WEIGHTS[code], states[-1]
        states.append(min(range(4), key=lambda s: (before[s] + w[s][t], s)))
    return states[::-1]


def _segments(keys: np.ndarray) -> list[tuple[int, int]]:
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
    return list(zip(first, [*first[1:], len(keys)], strict=True))


ORDERED = "part int, seq long, key long, conv_id long, turn long, role string, code int, text string, tie long"
OUT = "conv_id long, turn long, role string, action string, new_role string, out_turn long, n_inserted int, cost int, fragment string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.record_batch([np.full(n, part, np.int32), np.arange(seq, seq + n), *batch.columns], schema=_schema(ORDERED))
        seq += n


def _by_part(run):
    """``run`` over each part's rows by themselves; rows come by part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)].tolist()
            for a, b in zip(edges, edges[1:]):
                if held and held[0].column("part")[0].as_py() != part[a]:
                    yield from run(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from run(held)

    return each


ENDS = "key long, part int, matrix array<string>"


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matrices of a task's first and last conversations; its rows come in order."""
    schema = _schema(ENDS)
    open_, first = None, True  # key, part, rows of the matrix of the conversation at hand

    def row() -> pa.RecordBatch:
        key, part, rows = open_
        return pa.record_batch([[key], [part], [[str(x) for r in rows for x in r]]], schema=schema)

    for batch in batches:
        for part, key, code, tie in zip(*(batch.column(n).to_pylist() for n in ("part", "key", "code", "tie")), strict=True):
            if open_ is None or key != open_[0]:
                if open_ is not None and first:
                    yield row()
                    first = False
                open_ = (key, part, matrix([]))
            open_ = (key, part, [after(v, code, tie) for v in open_[2]])
    if open_ is not None:
        yield row()


KNOWN = "part int, key long, enters int, turns long, leaves int"


def _link(got: pa.Table) -> pa.Table:
    """For each task that a conversation spans: the state and count of turns before its part there, and the state after it; null at the conversation's own ends."""
    rows = sorted(zip(got["part"].to_pylist(), got["matrix"].to_pylist(), strict=True))
    squares = [[[int(x) for x in m[i : i + 4]] for i in range(0, 16, 4)] for _, m in rows]
    before = [START]
    for m in squares:
        before.append(through(before[-1], m))
    out, end = [], last_state(before[-1])
    for n in range(len(rows) - 1, -1, -1):
        begin = min(range(4), key=lambda s: (before[n][s] + squares[n][s][end], s)) if n else None
        out.append((rows[n][0], got["key"][0].as_py(), begin, (before[n][begin] >> TIE) % UNIT if n else 0, end if n < len(rows) - 1 else None))
        end = begin
    return pa.table([list(c) for c in zip(*out, strict=True)], schema=_schema(KNOWN))


def repair(rows: list[tuple], codes: list[int], states: list[int], turns: int, closed: bool) -> Iterator[tuple]:
    for i, ((conv, turn, role, text), code) in enumerate(zip(rows, codes, strict=True)):
        weight, action, put = STEPS[code][states[i]][states[i + 1]]
        name = ROLES[states[i + 1]]
        if "merge" in action:
            out = "\n" + text
        else:
            out = (CLOSE if turns else "") + "".join(OPEN.format(ROLES[x]) + CLOSE for x in put) + OPEN.format(name) + text
        turns += weight % UNIT
        cost, number, more = weight // UNIT, turns, len(put)
        if closed and i == len(rows) - 1:
            tail = TAILS[states[-1]]
            out += CLOSE + "".join(OPEN.format(ROLES[x]) + CLOSE for x in tail)
            cost, more = cost + INSERT * len(tail), more + len(tail)
        yield conv, turn, role, action, name, number, more, cost, out


def repaired(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each turn: what was done to it, its new role, the repaired turn that it is in (from 1), empty turns put in, cost, and its part of the rendering."""
    code = F.element_at(F.create_map(*(F.lit(x) for kv in CODES.items() for x in kv)), F.lower(F.trim(role)))
    rows = conversations.select(
        id_key(conv_id).alias("key"), F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.when(F.col(role).isNotNull(), code), F.lit(NONE)).alias("code"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = ("key", "turn", "role", F.xxhash64("text"))
    rows = rows.withColumn("tie", F.xxhash64("turn", "role", "text"))
    ordered = rows.repartitionByRange(pieces_of(rows, "text", PART), *order).sortWithinPartitions(*order, "text")
    ordered = table(ordered.mapInArrow(_number, ORDERED), "ordered")
    # a file's rows are in order but its splits are tasks of their own, so parts are put together again
    parts = ordered.select("part", "seq", "key", "code", "tie").repartition(partitions(ordered.sparkSession), "part").sortWithinPartitions("part", "seq")
    known = table(parts.mapInArrow(_by_part(_ends), ENDS).groupBy("key").applyInArrow(_link, KNOWN), "known")

    def run(got: pa.Table, ends: pa.Table) -> pa.Table:
        got = got.sort_by("seq")
        at = {k: (e, n, x) for k, e, n, x in zip(*(ends[c].to_pylist() for c in ("key", "enters", "turns", "leaves")), strict=True)}
        keys, turns = got["key"].to_numpy(), list(zip(got["code"].to_pylist(), got["tie"].to_pylist(), strict=True))
        rows = list(zip(*(got[n].to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True))
        out = []
        for a, b in _segments(keys):
            enters, count, leaves = at.get(int(keys[a]), (None, 0, None))
            start = NONE if enters is None else enters
            states = trace(turns[a:b], [0 if s == start else NEVER for s in range(4)], leaves)
            out += repair(rows[a:b], [c for c, _ in turns[a:b]], states, count, leaves is None)
        return pa.table([list(c) for c in zip(*out, strict=True)] if out else [[] for _ in _schema(OUT)], schema=_schema(OUT))

    return ordered.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(run, OUT)
