"""What a workload asks of a table, and a layout that serves it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TableScan:
    table: str


@dataclass(frozen=True)
class Filter:
    child: object
    #: column: inclusive range
    domain: dict[str, tuple]
    #: the share of rows that pass
    selectivity: float


@dataclass(frozen=True)
class Aggregate:
    child: object
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Join:
    left: object
    right: object
    on: tuple[str, str]


def filters(plan: object) -> list[Filter]:
    """All filters of a plan."""
    own = [plan] if isinstance(plan, Filter) else []
    below = [getattr(plan, n) for n in ("child", "left", "right") if hasattr(plan, n)]
    return own + [f for p in below for f in filters(p)]


def cluster_column(workload: list[object]) -> str | None:
    """The column whose filters leave out the most rows over all plans; of equal ones the first by name."""
    saved: dict[str, float] = {}
    for plan in workload:
        for f in filters(plan):
            for c in f.domain:
                saved[c] = saved.get(c, 0.0) + 1 - f.selectivity
    return min(saved, key=lambda c: (-saved[c], c), default=None)


def re_clustered(df: DataFrame, workload: list[object], parts: int) -> DataFrame:
    """df in ranges of the workload's best column, which lets stored minima and maxima prune; unchanged without filters."""
    column = cluster_column(workload)
    return df if column is None else df.repartitionByRange(parts, column).sortWithinPartitions(column)
