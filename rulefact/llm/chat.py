"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is: at most one system turn, then user and assistant turns in alternation, the last one the
assistant's. Dynamic programming over that automaton chooses, for each turn, to keep it, to relabel it, or to merge it into
the turn before, and where to insert empty turns; the sum of costs is the least possible. What a turn may do depends on its
role alone, so a run of turns is a 4 x 4 matrix in (min, +) arithmetic. Long conversations are cut into blocks by turn number;
a block of more than MOST rows (rows without conv_id or turn, turns that repeat) is sorted over range partitions and cut by
position into blocks of BLOCK rows at most. Blocks become matrices side by side, a chain over the matrices of a conversation
fixes the state at each block's ends, and the blocks are repaired side by side. A task holds the texts of one block of at most
MOST rows; of a conversation as a whole it holds one matrix for each block.

The result has one row per input turn with the text it renders to; a conversation's rendering is its rows in order.
Defined cases: roles are lower-cased and trimmed, a null or unknown role can only be relabelled (or merged); a null text is
empty; turns are ordered by turn (null last), then role, then text, so repeated rows stay beside each other; rows without
conv_id form one conversation; very long texts are kept whole; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulefact.llm.common import stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, MERGE_OTHER, INSERT = 3.0, 1.0, 4.0, 5.0
BLOCK, MOST = 1024, 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Inserting empty turns between states: (from, to) -> the inserted states, at most two.
_FILL = {(a, a): () for a in range(4)}
for _a in range(4):
    for _b in NEXT[_a]:
        _FILL.setdefault((_a, _b), (_b,))
    for _b in NEXT[_a]:
        for _c in NEXT[_b]:
            _FILL.setdefault((_a, _c), (_b, _c))


def moves(role: int) -> list[tuple[int, int, float, str, tuple[int, ...]]]:
    """All (from, to, cost, action, inserted before) of a turn of a role (1 to 3, or 0 if unknown), cheapest first."""
    found = []
    for a in range(4):
        if a != START:
            found.append((a, a, MERGE if a == role else MERGE_OTHER, "merge", ()))
        for (x, b), filled in _FILL.items():
            if x != a:
                continue
            for c in NEXT[b]:
                found.append((a, c, INSERT * len(filled) + (0.0 if c == role else RELABEL), "keep" if c == role else "relabel", filled))
    return sorted(found, key=lambda m: (m[2], m[0], m[1], m[3], m[4]))


_MOVES = {r: moves(r) for r in range(4)}


def _matrix(role: int) -> np.ndarray:
    out = np.full((4, 4), np.inf)
    for a, b, cost, *_ in _MOVES[role]:
        out[a, b] = min(out[a, b], cost)
    return out


_MATRIX = {r: _matrix(r) for r in range(4)}
#: Cost and insertions to end from a state: an assistant's turn is last; a conversation without turns stays empty.
_END = {START: (0.0, ()), ASSISTANT: (0.0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}


def _groups(parts: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of equal keys in sorted batches, as lists per column; a run that goes on in the next batch is joined."""
    last: tuple | None = None
    held: dict[str, list] = {}
    for part in parts:
        if not len(part):
            continue
        change = np.zeros(len(part), bool)
        for k in keys:
            change[1:] |= part[k].to_numpy()[1:] != part[k].to_numpy()[:-1]
        columns = {c: part[c].tolist() for c in part.columns}
        cuts = [0, *np.flatnonzero(change), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(columns[k][a] for k in keys)
            if key == last:
                for c, v in columns.items():
                    held[c] += v[a:b]
                continue
            if last is not None:
                yield last, held
            last, held = key, {c: v[a:b] for c, v in columns.items()}
    if last is not None:
        yield last, held


def _chunks(rows: Iterator[tuple], names: list[str], most: int = 5000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pd.DataFrame(held, columns=names)
            held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _products(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for (conv, block, part), run in _groups(parts, ["conv", "block", "part"]):
            m = _MATRIX[run["code"][0]]
            for code in run["code"][1:]:
                m = (m[:, :, None] + _MATRIX[code][None]).min(axis=1)
            yield conv, block, part, m.ravel().tolist()

    yield from _chunks(rows(), ["conv", "block", "part", "m"])


def _ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for (conv,), run in _groups(parts, ["conv"]):
            ms = [np.asarray(m).reshape(4, 4) for m in run["m"]]
            costs = [np.array([0.0, np.inf, np.inf, np.inf])]
            for m in ms:
                costs.append((costs[-1][:, None] + m).min(axis=0))
            final = costs[-1] + np.array([_END[s][0] for s in range(4)])
            state = int(np.argmin(final))
            ends = [state]
            for cost, m in zip(costs[-2::-1], ms[::-1], strict=True):
                state = int(np.argmin(cost + m[:, state]))
                ends.append(state)
            ends.reverse()
            for k, (block, part) in enumerate(zip(run["block"], run["part"], strict=True)):
                yield conv, block, part, ends[k], ends[k + 1], k == len(ms) - 1, float(final.min())

    yield from _chunks(rows(), ["conv", "block", "part", "enters", "leaves", "is_last", "total_cost"])


def _path(codes: list[int], enters: int, leaves: int) -> list[tuple]:
    """The cheapest moves from one state to another (ties: the first move in _MOVES)."""
    cost = [np.inf] * 4
    cost[enters] = 0.0
    back = []
    for code in codes:
        after, via = [np.inf] * 4, [None] * 4
        for move in _MOVES[code]:
            c = cost[move[0]] + move[2]
            if c < after[move[1]]:
                after[move[1]], via[move[1]] = c, move
        back.append(via)
        cost = after
    out, state = [], leaves
    for via in reversed(back):
        out.append(via[state])
        state = via[state][0]
    return out[::-1]


_OUT = "conv long, turn long, role string, new_role string, action string, inserted string, rendered string, cost double, total_cost double, block long, part long, place long"


def _repair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple]:
        for (conv, block, part), run in _groups(parts, ["conv", "block", "part"]):
            path = _path(run["code"], run["enters"][0], run["leaves"][0])
            texts, turns, roles = run["text"], run["turn"], run["role"]
            for k, (a, b, cost, action, filled) in enumerate(path):
                text = texts[k] or ""
                if action == "merge":
                    body, at = "\n" + text, a
                else:
                    body, at = "" if a == START else CLOSE, b
                    for s in filled:
                        body += f"{OPEN}{ROLES[s - 1]}\n{CLOSE}"
                    body += f"{OPEN}{ROLES[at - 1]}\n{text}"
                added = list(filled)
                if run["is_last"][0] and k == len(path) - 1:
                    body += CLOSE
                    for s in _END[at][1]:
                        body += f"{OPEN}{ROLES[s - 1]}\n{CLOSE}"
                    added += list(_END[at][1])
                    cost += _END[at][0]
                yield conv, turns[k], roles[k], ROLES[at - 1], action, ",".join(ROLES[s - 1] for s in added), body, cost, run["total_cost"][0], block, part, k

    yield from _chunks(rows(), [c.split()[0] for c in _OUT.split(", ")], 1000)


_ROW = "conv long, turn long, role string, text string, code int, block long, part long"


def _cut(most: int):
    """Numbers the rows of each block in a sorted range partition: a new part every `most` rows; parts ascend with the partitions."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, seen, number = None, 0, (TaskContext.get().partitionId() + 1) << 32
        for rows in parts:
            out = np.empty(len(rows), np.int64)
            for k, key in enumerate(zip(rows["conv"], rows["block"], strict=True)):
                if key != last or seen == most:
                    last, seen, number = key, 0, number + 1
                seen += 1
                out[k] = number
            rows["part"] = out
            yield rows

    return run


def _in_blocks(x: DataFrame, block: int, most: int) -> DataFrame:
    """x with `part`: 0 where a block is small enough, else its parts in order."""
    sizes = stored(x.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("conv", "block"), "chat-large")  # each stands for more than `most` rows
    if sizes.isEmpty():
        return x.withColumn("part", F.lit(0).cast("long"))
    # A number of its own parts rows that are alike in all, so that a range can end among them.
    order = ["conv", "block", F.col("turn").asc_nulls_last(), "role", "text", "tie"]
    large = x.join(sizes, ["conv", "block"], "left_semi").withColumn("tie", F.monotonically_increasing_id())
    large = large.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.lit(0).cast("long")).select("conv", "turn", "role", "text", "code", "block", "part")
    large = stored(large.withColumn("turn", F.coalesce("turn", F.lit(_NONE))).mapInPandas(_cut(block), _ROW), "chat-parts").withColumn("turn", F.when(F.col("turn") != _NONE, F.col("turn")))
    return x.join(sizes, ["conv", "block"], "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(large)


_NONE = -(1 << 62)  # stands for a null conv_id or turn


def repair(turns: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """One row per turn: its role after repair, the action, roles of empty turns inserted around it, the text it renders to,
    its cost and its conversation's; block, part and place give its order in the conversation."""
    role = F.trim(F.lower(F.col("role").cast("string")))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), role), F.lit(0)).cast("int")
    last = (1 << 62) - 1
    t = F.col("turn").cast("long")
    x = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"), t.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), code.alias("code"), F.coalesce(F.floor(t / block), F.lit(last)).cast("long").alias("block"))
    x = _in_blocks(x, block, most)
    keys = ["conv", "block", "part"]
    # Products need the order of the roles alone: the texts stay where they are; equal turns are ordered by role, as below.
    slim = x.select(*keys, "turn", "role", "code").repartition(*keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_last(), "role")
    products = slim.select(*keys, "code").mapInPandas(_products, "conv long, block long, part long, m array<double>")
    ends = products.repartition("conv").sortWithinPartitions(*keys).mapInPandas(_ends, "conv long, block long, part long, enters int, leaves int, is_last boolean, total_cost double")
    ends = stored(ends, "chat-ends")
    # Dealt out before the join: whatever join Spark picks, a block stays in one task.
    joined = x.repartition(*keys).join(ends, keys).sortWithinPartitions(*keys, F.col("turn").asc_nulls_last(), "role", "text")
    out = joined.select(*keys, F.coalesce("turn", F.lit(_NONE)).alias("turn"), "role", "text", "code", "enters", "leaves", "is_last", "total_cost").mapInPandas(_repair, _OUT)
    back = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return out.select(back("conv").alias("conv_id"), back("turn").alias("turn"), "role", "new_role", "action", "inserted", "rendered", "cost", "total_cost", "block", "part", "place")
