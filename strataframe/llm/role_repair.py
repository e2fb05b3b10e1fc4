"""Minimum-cost repair of the roles of a conversation, and its rendering.

A legal conversation is an optional system message, then user and assistant in turn, with the assistant last. Every turn
may keep or change its role, join the message before it, or get an empty message of another role put before it; the
cheapest way through the automaton of legal turns is chosen by dynamic programming, with fewer messages on ties. Where
repairs still tie, the choice may depend on where a part ends.

A step of the program is a matrix of costs between the automaton's states, so runs of turns combine like numbers: the turns are
range-partitioned by conversation and order, each part reduces the conversations it cuts to one matrix, the matrices
of neighbouring parts are chained on the driver (at most two per part), and each part then repairs its turns between known states. A
conversation with a third of all turns is so spread over many tasks.

Defined results: a turn without a known role costs nothing to relabel; null text is empty; turns are ordered by number, nulls last, then
role and text; rows with a null conv_id are one conversation; repeated rows are turns of their own; further columns are ignored; no turns, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataframe.llm.shared import Scratch

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ("", "system", "user", "assistant")
#: States a state may be followed by with a new message.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: A cost is a pair (cost, messages), compared in this order; sums are exact however long the conversation. This one is infinite.
NEVER = (float("inf"), 0)


@dataclass(frozen=True)
class Costs:
    merge: int = 2
    relabel: int = 3
    insert: int = 4


def plus(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1]


def moves(costs: Costs) -> dict[int, list[tuple[int, int, tuple, str, int]]]:
    """By role of a turn (0: unknown) its moves: from state, to state, cost, action, state of an empty message put before."""
    out = {}
    for role in range(4):
        rows = []
        for state in range(4):
            for to in (SYSTEM, USER, ASSISTANT):
                base = 0 if role in (START, to) else costs.relabel
                said = "keep" if role == to else "relabel"
                if to in LEGAL[state]:
                    rows.append((state, to, (base, 1), said, START))
                if to == state:
                    rows.append((state, to, (base + costs.merge, 0), "merge" if said == "keep" else "relabel and merge", START))
                for between in LEGAL[state]:
                    if to in LEGAL[between]:
                        rows.append((state, to, (base + costs.insert, 2), "insert and " + said, between))
        out[role] = rows
    return out


def closing(state: int, costs: Costs) -> tuple[tuple, list[int]]:
    """Cost and empty messages that end a conversation in a state legally."""
    if state in (START, ASSISTANT):
        return (0, 0), []
    added = [ASSISTANT] if state == USER else [USER, ASSISTANT]
    return (costs.insert * len(added), len(added)), added


def step(reached: list[tuple], rows: list[tuple], back: list | None = None) -> list[tuple]:
    out, chosen = [NEVER] * 4, [None] * 4
    for move in rows:
        cost = plus(reached[move[0]], move[2])
        if cost < out[move[1]] and cost[0] < NEVER[0]:
            out[move[1]], chosen[move[1]] = cost, move
    if back is not None:
        back.append(chosen)
    return out


def matrix(roles: list[int], table: dict) -> list[list[tuple]]:
    """Costs from each state to each through the turns."""
    out = []
    for state in range(4):
        reached = [(0, 0) if s == state else NEVER for s in range(4)]
        for role in roles:
            reached = step(reached, table[role])
        out.append(reached)
    return out


def path(roles: list[int], start: int, end: int | None, table: dict, costs: Costs) -> tuple[list[tuple], int]:
    """The cheapest moves from a state, to a state or to a legal end; and the last state."""
    reached, back = [(0, 0) if s == start else NEVER for s in range(4)], []
    for role in roles:
        reached = step(reached, table[role], back)
    if end is None:
        end = min((s for s in range(4) if reached[s] < NEVER), key=lambda s: (plus(reached[s], closing(s, costs)[0]), s))
    out, state = [], end
    for chosen in reversed(back):
        out.append(chosen[state])
        state = chosen[state][0]
    return out[::-1], end


def _runs(part: list, conv: list) -> list[tuple]:
    out, lo = [], 0
    for i in range(1, len(conv) + 1):
        if i == len(conv) or conv[i] != conv[lo] or part[i] != part[lo]:
            out.append((part[lo], conv[lo], lo, i))
            lo = i
    return out


def _edges(costs: Costs):
    """Turns, costs and matrix of a part's first and last conversation, which may go on in other parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = moves(costs)
        seen: list[list] = []
        for batch in batches:
            roles = [ROLES.get(r, 0) for r in batch.column("role").to_pylist()]
            for part, conv, lo, hi in _runs(batch.column("part").to_pylist(), batch.column("conv_id").to_pylist()):
                rows = matrix(roles[lo:hi], table)
                if seen and seen[-1][:2] == [part, conv]:
                    old = seen[-1]
                    old[2] += hi - lo
                    old[3] = chain(old[3], rows)
                    continue
                # Of this part only the first conversation and the latest are kept; the last of the part before stays.
                if len(seen) > 1 and seen[-1][0] == seen[-2][0] == part:
                    seen.pop()
                seen.append([part, conv, hi - lo, rows])
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([s[0] for s in seen], pa.int32()), pa.array([s[1] for s in seen], pa.int64()), pa.array([s[2] for s in seen], pa.int64()),
                 pa.array([[None if c[0] == NEVER[0] else c[0] for r in s[3] for c in r] for s in seen], pa.list_(pa.int64())),
                 pa.array([[c[1] for r in s[3] for c in r] for s in seen], pa.list_(pa.int64()))], names=["part", "conv_id", "turns", "costs", "messages"])
    return run


def _least(sums) -> tuple:
    """The least pair; every infinite one is ``NEVER``."""
    return min((c for c in sums if c[0] < NEVER[0]), default=NEVER)


def chain(a: list[list[tuple]], b: list[list[tuple]]) -> list[list[tuple]]:
    return [[_least(plus(a[s][m], b[m][t]) for m in range(4)) for t in range(4)] for s in range(4)]


def boundaries(edges: list, costs: Costs) -> dict[tuple, tuple]:
    """By part and conversation: turns and messages before it, state it starts in, state it must end in (None: it is the last)."""
    out = {}
    edges = sorted(edges, key=lambda e: e.part)
    i = 0
    while i < len(edges):
        j = i + 1
        while j < len(edges) and edges[j].conv_id == edges[i].conv_id and edges[j].part > edges[j - 1].part:
            j += 1
        flat = [[NEVER if c is None else (c, n) for c, n in zip(e.costs, e.messages)] for e in edges[i:j]]
        steps = [[m[4 * s:4 * s + 4] for s in range(4)] for m in flat]
        reached = [[(0, 0), NEVER, NEVER, NEVER]]
        for m in steps:
            reached.append([_least(plus(reached[-1][s], m[s][t]) for s in range(4)) for t in range(4)])
        state = min((s for s in range(4) if reached[-1][s] < NEVER), key=lambda s: (plus(reached[-1][s], closing(s, costs)[0]), s))
        states = [state]
        for k in range(len(steps) - 1, -1, -1):
            state = min(range(4), key=lambda s: (plus(reached[k][s], steps[k][s][state]), s))
            states.append(state)
        states = states[::-1]
        turns = 0
        for k, e in enumerate(edges[i:j]):
            messages = reached[k][states[k]][1]
            out[(e.part, e.conv_id)] = (turns, messages, states[k], states[k + 1] if k + 1 < j - i else None)
            turns += e.turns
        i = j
    return out


SCHEMA = "conv_id long, message_no long, turn_no long, turn long, role string, action string, text string, rendered string"


def _repair(costs: Costs, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, edges = moves(costs), known.value
        held: list[tuple] = []

        def done(rows: list[tuple]) -> list[tuple]:
            part, conv = rows[0][:2]
            turns, messages, state, end = edges.get((part, conv), (0, 0, START, None))
            chosen, last = path([ROLES.get(r[3], 0) for r in rows], state, end, table, costs)
            out = []
            for (_, _, turn, _, text), (_, to, _, action, before) in zip(rows, chosen):
                if before:
                    messages += 1
                    out.append((conv, messages, None, None, NAMES[before], "insert", "", f"<|{NAMES[before]}|>\n"))
                turns += 1
                if "merge" in action:
                    shown = "\n" + text
                else:
                    messages += 1
                    shown = ("\n" if messages > 1 else "") + f"<|{NAMES[to]}|>\n" + text
                if before and messages > 2:
                    out[-1] = (*out[-1][:-1], "\n" + out[-1][-1])
                out.append((conv, messages, turns, turn, NAMES[to], action.removeprefix("insert and "), text, shown))
            if end is None:
                for role in closing(last, costs)[1]:
                    messages += 1
                    out.append((conv, messages, None, None, NAMES[role], "insert", "", f"\n<|{NAMES[role]}|>\n"))
            return out

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.string()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                              names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "turn", "role", "text"))))
            out = []
            for row in rows:
                if held and held[-1][:2] != row[:2]:
                    out += done(held)
                    held = []
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(done(held))
    return run


def repair_roles(turns: DataFrame, scratch: Scratch, *, costs: Costs = Costs()) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, text) and per inserted empty message, in ``SCHEMA``.

    ``message_no`` numbers the messages of the repaired conversation; turns with one number are one message. ``rendered``, put
    together in order of message_no and turn_no, is the conversation's text. ``turn_no`` is null for inserted messages.
    """
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = scratch.write(rows.withColumn("part", F.spark_partition_id()), "turns")
    # The files are read in pieces of any size, so the parts are dealt anew by their number.
    dealt = rows.repartition("part").sortWithinPartitions("part", *order)
    edges = dealt.select("part", "conv_id", "role").mapInArrow(_edges(costs), "part int, conv_id long, turns long, costs array<long>, messages array<long>").collect()
    known = turns.sparkSession.sparkContext.broadcast(boundaries(edges, costs))
    return dealt.mapInArrow(_repair(costs, known), SCHEMA)
