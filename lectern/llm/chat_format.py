"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. For each input turn dynamic programming over the automaton's states chooses to append it under a role,
to merge it into the turn before, or to insert an empty turn first; the cheapest sequence is rendered.

A conversation is processed in blocks of BLOCK turn numbers. Each block is summed up as a matrix of least costs from state
to state; the matrices are chained, which fixes every block's first and last state, and each block is then repaired on its own. So a
conversation that holds a third of all rows never meets in one task with its texts.

Edge cases: a null text is empty; a null or unknown role costs RELABEL under any role; a null turn number comes first;
equal turn numbers go by role, then text; repeated rows are turns each; ties prefer append, then merge, then
insert, and user before assistant before system; rows with a null conversation form one; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 1024
#: Turns that one pandas group holds, about: many short conversations share a group. Null turn numbers stand here.
GROUP_ROWS, FIRST = 8192, -(1 << 63)
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
# Other names of the roles.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, MERGE, INSERT = 2.0, 1.0, 2.5
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"


def steps() -> list[tuple[int, int, str, int]]:
    """(state, next state, action, inserted role or 0), in order of preference."""
    out = []
    order = (USER, ASSISTANT, SYSTEM)
    for s in range(4):
        for o in order:
            if o in NEXT[s]:
                out.append((s, o, "append", 0))
        if s != START:
            out.append((s, s, "merge", 0))
        for o in order:
            for between in NEXT[s]:
                if o in NEXT[between] and o not in NEXT[s]:
                    out.append((s, o, "insert", between))
    return out


STEPS = steps()


def step_cost(role: int, to: int, action: str) -> float:
    return (0.0 if role == to else RELABEL) + {"append": 0.0, "merge": MERGE, "insert": INSERT}[action]


def closing(state: int) -> tuple[list[int], float]:
    """The empty turns that end a conversation legally, and their cost."""
    added = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]
    return added, INSERT * len(added)


def sweep(roles: list[int], start: int) -> tuple[list[float], list[list[int]]]:
    """Least cost of each final state from ``start``, and for each turn the step that led to each state."""
    cost = [math.inf] * 4
    cost[start] = 0.0
    back = []
    for role in roles:
        new, via = [math.inf] * 4, [-1] * 4
        for k, (s, o, action, _) in enumerate(STEPS):
            c = cost[s] + step_cost(role, o, action)
            if c < new[o]:
                new[o], via[o] = c, k
        cost = new
        back.append(via)
    return cost, back


def path(roles: list[int], start: int, end: int) -> list[int]:
    """The steps of the cheapest way from start to end."""
    _, back = sweep(roles, start)
    out, state = [], end
    for via in reversed(back):
        out.append(via[state])
        state = STEPS[via[state]][0]
    return out[::-1]


def shielded(text: str) -> str:
    """The text with its own marks broken, so that only the template opens and closes turns."""
    return text.replace("<|", "< |")


def runs(group: pd.DataFrame, by: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows of values) of each key, rows in order; turns of one number go by role, then text."""
    order = [c for c in ("k", "b", "t", "r", "x") if c in group.columns]
    group = group.sort_values(order, kind="stable", na_position="first")
    lists = {c: [None if isinstance(v, float) and v != v else v for v in group[c].tolist()] for c in (*by, *values)}
    keys = zip(*(lists[c] for c in by))
    for key, rows in groupby(zip(keys, zip(*(lists[c] for c in values))), key=lambda x: x[0]):
        yield key, [row for _, row in rows]


def role_code(name) -> int:
    return ALIASES.get(name.strip().lower(), 0) if isinstance(name, str) else 0


def repair(df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, piece, role_in, role, action, rendered, cost): one row for each output piece.

    A conversation's text is its ``rendered`` in the order of turn, then piece. Inserted empty turns
    stand before the turn that needs them (or, at the end, after the last one) with a null role_in.
    """
    rows = df.select(
        F.col(key).cast("string").alias("k"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("t"),
        F.col(role).cast("string").alias("r"),
        F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.coalesce(F.floor(F.col(turn).cast("long") / BLOCK), F.lit(FIRST)).cast("long").alias("b"),
    )
    groups = max(1, math.ceil(rows.count() / GROUP_ROWS))
    dealt = lambda *columns: F.pmod(F.xxhash64(*columns), F.lit(groups)).alias("g")

    def matrices(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k, b), turns in runs(group, ("k", "b"), ("t", "r")):
            roles = [role_code(r) for _, r in turns]
            out.append((k, b, [c for s in range(4) for c in sweep(roles, s)[0]]))
        return pd.DataFrame(out, columns=["k", "b", "m"])

    def chains(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k,), blocks in runs(group, ("k",), ("b", "m")):
            cost, back = [0.0, math.inf, math.inf, math.inf], []
            for _, m in blocks:
                ways = [min((cost[s] + m[4 * s + o], s) for s in range(4)) for o in range(4)]
                cost = [c for c, _ in ways]
                back.append([s for _, s in ways])
            end = min(range(4), key=lambda o: (cost[o] + closing(o)[1], o))
            total, last = cost[end] + closing(end)[1], True
            for (b, _), via in zip(reversed(blocks), reversed(back)):
                out.append((k, b, via[end], end, last, total))
                end, last = via[end], False
        return pd.DataFrame(out, columns=["k", "b", "start", "end", "last", "cost"])

    def rendered(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (k, _), turns in runs(group, ("k", "b"), ("t", "r", "x", "start", "end", "last", "cost")):
            start, end, last, cost = turns[0][3:]
            open_turn = bool(start != START)
            for (t, r, x, *_), step in zip(turns, path([role_code(r) for _, r, *_ in turns], int(start), int(end))):
                _, to, action, between = STEPS[step]
                piece = 0
                if between:
                    out.append((k, t, piece, None, ROLES[between], "insert", CLOSE * open_turn + OPEN.format(ROLES[between]), cost))
                    piece, open_turn = 1, True
                if action == "merge":
                    out.append((k, t, piece, r, ROLES[to], "merge", "\n\n" + shielded(x), cost))
                else:
                    done = "keep" if role_code(r) == to else "relabel"
                    out.append((k, t, piece, r, ROLES[to], done, CLOSE * open_turn + OPEN.format(ROLES[to]) + shielded(x), cost))
                open_turn = True
            if last:
                for n, added in enumerate(closing(int(end))[0], piece + 1):
                    out.append((k, t, n, None, ROLES[added], "insert", CLOSE + OPEN.format(ROLES[added]), cost))
                out[-1] = (*out[-1][:6], out[-1][6] + CLOSE, cost)
        return pd.DataFrame(out, columns=["k", "t", "piece", "role_in", "role", "action", "rendered", "cost"])

    sums = rows.select("k", "b", "t", "r", dealt("k", "b")).groupBy("g").applyInPandas(matrices, "k string, b long, m array<double>")
    states = materialize(sums.select("*", dealt("k")).groupBy("g").applyInPandas(chains, "k string, b long, start int, end int, last boolean, cost double"))
    joined = rows.join(states.withColumnsRenamed({"k": "sk", "b": "sb"}), F.col("k").eqNullSafe(F.col("sk")) & (F.col("b") == F.col("sb"))).drop("sk", "sb")
    schema = "k string, t long, piece int, role_in string, role string, action string, rendered string, cost double"
    done = joined.select("*", dealt("k", "b")).groupBy("g").applyInPandas(rendered, schema)
    return done.select(
        F.col("k").cast(df.schema[key].dataType).alias(key), F.nullif("t", F.lit(FIRST)).alias(turn), "piece", "role_in", "role", "action", "rendered", "cost"
    )
