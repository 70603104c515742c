"""Lock tables, replayed: which requests are granted, queued or denied."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

READ, WRITE = "read", "write"
#: mode asked for: modes held by anyone under which it is granted (fixed values)
COMPATIBLE = {"IS": ("IS", "IX", "S"), "IX": ("IS", "IX"), "S": ("IS", "S"), "X": ()}
MODES = ("IS", "IX", "S", "X")


class LockTable:
    """Read and write locks on objects. What can't be granted waits in line; a reader passes waiting writers while nobody writes."""

    def __init__(self) -> None:
        self.held: dict[object, dict[object, str]] = {}
        self.queue: dict[object, deque] = {}

    def _grants(self, t: object, o: object, mode: str) -> bool:
        held = self.held.setdefault(o, {})
        others = [m for h, m in held.items() if h != t]
        if mode == READ and WRITE not in others or mode == WRITE and not others:
            held[t] = mode
            return True
        return False

    def lock(self, t: object, o: object, mode: str) -> str:
        """granted, queued, or held: the lock is there already. A sole reader is made a writer at once."""
        own = self.held.get(o, {}).get(t)
        if own == mode or own == WRITE:
            return "held"
        line = self.queue.setdefault(o, deque())
        if self._grants(t, o, mode):
            return "granted"
        line.append((t, mode))
        return "queued"

    def release(self, t: object, o: object) -> list:
        """Who is granted a lock because t gives up its own: from the head of the line until one can't be."""
        self.held.get(o, {}).pop(t, None)
        line, out = self.queue.get(o, deque()), []
        while line and self._grants(line[0][0], o, line[0][1]):
            out.append(line.popleft()[0])
        return out

    def state(self, o: object) -> tuple[dict, list]:
        return dict(self.held.get(o, {})), list(self.queue.get(o, ()))


class LockTree:
    """Locks on paths: intentions on all ancestors, the lock itself on the leaf; nothing waits.

    A denial takes back all that the transaction holds.
    """

    def __init__(self) -> None:
        self.held: dict[tuple, list[tuple[object, str]]] = {}

    def can_grant(self, path: tuple, mode: str) -> bool:
        return all(m in COMPATIBLE[mode] for _, m in self.held.get(path, ()))

    def lock(self, t: object, path: tuple, mode: str) -> bool:
        wants = [(path[:i], "I" + mode) for i in range(1, len(path))] + [(path, mode)]
        if not all(self.can_grant(p, m) for p, m in wants):
            self.release(t)
            return False
        for p, m in wants:
            self.held.setdefault(p, []).append((t, m))
        return True

    def release(self, t: object) -> None:
        self.held = {p: left for p, h in self.held.items() if (left := [x for x in h if x[0] != t])}

    def state(self, path: tuple) -> list[tuple[object, str]]:
        return list(self.held.get(path, ()))


def compatibility(spark: SparkSession) -> DataFrame:
    """(asked, held, granted) for all modes, with null for an object that nobody holds."""
    rows = [(a, h, h is None or h in COMPATIBLE[a]) for a in MODES for h in (None, *MODES)]
    return spark.createDataFrame(rows, "asked string, held string, granted boolean")


def _each(df: DataFrame, group: str, seq: str, step: Callable[[], Callable[[dict], str]], outcome: str) -> DataFrame:
    kinds = ", ".join(f"{n} {k}" for n, k in df.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, act = rows.sort_values(seq, kind="stable"), step()
        return rows.assign(**{outcome: [act(r) for r in rows.to_dict("records")]})

    return df.groupBy(group).applyInPandas(run, f"{kinds}, {outcome} string")


def replayed(df: DataFrame, obj: str, seq: str, transaction: str, action: str) -> DataFrame:
    """df with the `outcome` of each row's action (read, write or release) in the order of seq.

    Objects don't touch each other, so each one is a group and they run in parallel. A release lists who is granted.
    """

    def step() -> Callable[[dict], str]:
        table = LockTable()

        def act(r: dict) -> str:
            if r[action] == "release":
                return ",".join(map(str, table.release(r[transaction], r[obj])))
            return table.lock(r[transaction], r[obj], r[action])

        return act

    return _each(df, obj, seq, step, "outcome")


def tree_replayed(df: DataFrame, tree: str, seq: str, transaction: str, path: str, action: str) -> DataFrame:
    """df with the `outcome` of each row's action (S, X or release) on a path `a/b/c`, in the order of seq; trees run in parallel."""

    def step() -> Callable[[dict], str]:
        locks = LockTree()

        def act(r: dict) -> str:
            if r[action] == "release":
                locks.release(r[transaction])
                return "released"
            return "granted" if locks.lock(r[transaction], tuple(r[path].split("/")), r[action]) else "denied"

        return act

    return _each(df, tree, seq, step, "outcome")
