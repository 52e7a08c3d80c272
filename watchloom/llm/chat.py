"""Chat formatting by minimum-cost role repair.

A conversation is legal if it has at most one system turn, first, and then user and assistant turns
that alternate, beginning with user and ending with assistant. Dynamic programming over that
automaton chooses for each turn to keep or relabel it, as a turn of its own or merged into the one
before, with empty turns inserted where a step needs them, at the least total cost; the repaired
sequence is rendered.

Turns are range-sorted and numbered by where they stand in their conversation, and a conversation is dealt in blocks of
``BLOCK`` turns, whatever their numbers: turns without a number, or all of one, are dealt like others. A block is a min-plus matrix over the
automaton's states, the matrices of a conversation compose to the states at which its best path enters
and leaves each block, and each block is then repaired on its own, so no conversation meets in a task.
A rendered conversation is the concatenation of its parts in order; one of at most a block is one row.

Defined results: roles are trimmed and lower-cased, any other role (null too) must be relabelled; null
text is empty; a null turn comes last; turns of one number are ordered by role and a hash of the text; rows without a
conversation are conversations of one turn; a conversation has at least one turn; repeated rows are
turns of their own; a very long text is one turn; an empty table gives an empty result; of equal costs, the choice listed first wins; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchloom.llm.common import discard, materialize

ROLES = ("system", "user", "assistant")
OTHER = len(ROLES)
#: States: nothing yet, or the role of the last turn. The turns that may follow each.
START = 0
FOLLOW = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FINAL = 3
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: What happens to a turn: (cost, next state, merged, roles of the empty turns inserted before it)
Choice = tuple[float, int, bool, tuple[int, ...]]


@lru_cache(64)
def fillers(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which ``role`` may follow ``state``."""
    reach: list[tuple[int, tuple[int, ...]]] = [(state, ())]
    for at, path in reach:
        if role in FOLLOW[at]:
            return path
        if len(path) < 3:
            reach += [(r + 1, (*path, r)) for r in FOLLOW[at]]
    return None


@lru_cache(64)
def choices(state: int, role: int) -> tuple[Choice, ...]:
    """What may happen to a turn of ``role`` in ``state``, in the order in which ties are broken."""
    out: list[Choice] = []
    for label in sorted(range(OTHER), key=lambda r: (r != role, r)):
        change = 0.0 if label == role else RELABEL
        if state == label + 1:
            out.append((change + MERGE, state, True, ()))
        path = fillers(state, label)
        if path is not None:
            out.append((change + INSERT * len(path), label + 1, False, path))
    return tuple(sorted(out, key=lambda c: (c[0], len(c[3]), c[2])))


def ending(state: int) -> tuple[int, ...]:
    """The empty turns that end a conversation in ``state``."""
    return {0: (), 1: (1, 2), 2: (2,), 3: ()}[state]


@lru_cache(8)
def step(role: int) -> np.ndarray:
    m = np.full((4, 4), np.inf)
    for s in range(4):
        for cost, to, _, _ in choices(s, role):
            m[s, to] = min(m[s, to], cost)
    return m


def block_matrix(roles: np.ndarray) -> np.ndarray:
    """Least cost from each state before the turns to each after them."""
    m = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        m = (m[:, :, None] + step(int(r))[None]).min(1)
    return m


def path_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(enter, leave) of each block on the best path."""
    to_end = [np.array([INSERT * len(ending(s)) for s in range(4)])]
    for m in reversed(matrices):
        to_end.append((m + to_end[-1][None]).min(1))
    to_end.reverse()
    out, at = [], START
    for k, m in enumerate(matrices):
        to = int(np.argmin(m[at] + to_end[k + 1]))
        out.append((at, to))
        at = to
    return out


def repair(roles: list[int], enter: int, leave: int) -> tuple[float, list[Choice]]:
    """The best choices from ``enter`` to ``leave``."""
    cost = [[np.inf] * 4 for _ in range(len(roles) + 1)]
    cost[-1][leave] = 0.0
    for k in range(len(roles) - 1, -1, -1):
        for s in range(4):
            cost[k][s] = min((c + cost[k + 1][to] for c, to, _, _ in choices(s, roles[k])), default=np.inf)
    out, at = [], enter
    for k, role in enumerate(roles):
        best = next(c for c in choices(at, role) if c[0] + cost[k + 1][c[1]] == cost[k][at])
        out.append(best)
        at = best[1]
    return cost[0][enter], out


def escape(text: str | None) -> str:
    """Text in which no mark of the format can begin."""
    return (text or "").replace("<|", "< |")


def render(texts: list[str | None], made: list[Choice], enter: int, last: bool) -> tuple[str, int, int]:
    """A part's text, the turns that begin in it, and the empty turns inserted."""
    out: list[str] = []
    live, turns, empty = enter != START, 0, 0

    def begin(role: int) -> None:
        nonlocal live, turns
        if live:
            out.append(CLOSE)
        out.append(f"{OPEN}{ROLES[role]}\n")
        live, turns = True, turns + 1

    for text, (_, to, merged, path) in zip(texts, made, strict=True):
        for r in path:
            begin(r)
            empty += 1
        if merged:
            out.append("\n")
        else:
            begin(to - 1)
        out.append(escape(text))
    if last:
        state = made[-1][1] if made else enter
        for r in ending(state):
            begin(r)
            empty += 1
        if live:
            out.append(CLOSE)
    return "".join(out), turns, empty


def by_group(keys: list[str], work: Callable[[tuple, pd.DataFrame], dict]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``work`` on each run of equal ``keys`` of a sorted partition, a run at a time in memory."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out = None, []
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            if not len(frame):
                continue
            k = frame[keys]
            v = k.to_numpy()
            starts = np.flatnonzero(np.append(True, (v[1:] != v[:-1]).any(axis=1)))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                out.append(work(tuple(v[a].tolist()), frame.iloc[a:b]))
            rest = frame.iloc[starts[-1] :]
            if len(out) >= 1000:
                yield pd.DataFrame(out)
                out = []
        if rest is not None and len(rest):
            out.append(work(tuple(rest[keys].iloc[0].tolist()), rest))
        if out:
            yield pd.DataFrame(out)

    return run


def placed(rows: DataFrame) -> DataFrame:
    """A written table of turns with their ``position`` in the conversation and the block that it is in. A range of
    the sorted turns is numbered from the number of turns in the ranges before it, so no conversation is sorted in one task."""
    order = ["conv", "alone", "turn", "role", "order", "mark"]
    sheets = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sheets = materialize(sheets.select("conv", "alone", "role", "text", F.spark_partition_id().alias("sheet"), place.alias("place")), "turn-sheets")
    discard(rows)
    before = Window.orderBy("sheet").rowsBetween(Window.unboundedPreceding, -1)  # a row a sheet
    starts = sheets.groupBy("sheet").agg(F.count(F.lit(1)).alias("n")).select(F.col("sheet").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = sheets.join(starts, F.col("sheet") == F.col("s")).select("conv", "alone", "role", "text", (F.col("start") + F.col("place")).alias("at"))
    firsts = numbered.groupBy("conv", "alone").agg(F.min("at").alias("first")).withColumnsRenamed({"conv": "c", "alone": "a"})
    firsts = materialize(firsts, "turn-firsts")
    own = numbered.join(firsts, (F.col("conv") == F.col("c")) & (F.col("alone") == F.col("a"))).withColumn("position", F.col("at") - F.col("first"))
    out = materialize(own.select("conv", "alone", "role", "text", "position", F.floor(F.col("position") / BLOCK).alias("block")), "turns-placed")
    discard(sheets)
    discard(firsts)
    return out


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per part of a conversation: conv_id, part, parts, n_turns, n_out, n_merged,
    n_relabelled, n_inserted, cost, rendered."""
    role = F.lower(F.trim("role"))
    code = F.coalesce(*[F.when(role == r, F.lit(k)) for k, r in enumerate(ROLES)], F.lit(OTHER))
    # keys without nulls: rows without a conversation have a number of their own in its place
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv"), alone.alias("alone"),
        F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), code.alias("role"), F.xxhash64("text").alias("order"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("mark"))
    rows = placed(materialize(rows, "turns"))
    keys, order = ["conv", "alone", "block"], ["position"]

    def measure(key: tuple, g: pd.DataFrame) -> dict:
        return {**dict(zip(keys, key, strict=True)), "matrix": block_matrix(g["role"].to_numpy()).ravel().tolist()}

    blocks = rows.select(*keys, *order, "role").repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(by_group(keys, measure), "conv long, alone long, block long, matrix array<double>")
    ordered = blocks.repartition("conv", "alone").sortWithinPartitions(*keys)

    def route(key: tuple, g: pd.DataFrame) -> dict:
        states = path_states([np.array(m).reshape(4, 4) for m in g["matrix"]])
        return {"conv": key[0], "alone": key[1], "plan": [{"block": int(b), "part": i, "parts": len(g), "enter": a, "leave": z} for i, (b, (a, z)) in enumerate(zip(g["block"], states, strict=True))]}

    plan = ordered.mapInPandas(by_group(["conv", "alone"], route), "conv long, alone long, plan array<struct<block: long, part: int, parts: int, enter: int, leave: int>>")
    plan = materialize(plan.select("conv", "alone", F.inline("plan")), "chat-plan")

    def write(key: tuple, g: pd.DataFrame) -> dict:
        enter, leave, part, parts = (int(g[c].iloc[0]) for c in ("enter", "leave", "part", "parts"))
        roles = [int(r) for r in g["role"]]
        cost, made = repair(roles, enter, leave)
        last = part == parts - 1
        text, n_out, empty = render(list(g["text"]), made, enter, last)
        cost += INSERT * len(ending(leave)) if last else 0.0
        return {
            "conv": key[0], "alone": key[1], "part": part, "parts": parts, "n_turns": len(g), "n_out": n_out, "n_merged": sum(c[2] for c in made),
            "n_relabelled": sum(c[1] - 1 != r for c, r in zip(made, roles, strict=True)), "n_inserted": empty, "cost": cost, "rendered": text,
        }

    both = rows.join(plan, keys).repartition(*keys).sortWithinPartitions(*keys, *order)
    out = both.mapInPandas(by_group(keys, write), "conv long, alone long, part int, parts int, n_turns long, n_out long, n_merged long, n_relabelled long, n_inserted long, cost double, rendered string")
    return out.select(F.when(F.col("alone") < 0, F.col("conv")).alias("conv_id"), *out.columns[2:])
