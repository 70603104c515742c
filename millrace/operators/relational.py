"""Projection, range filters, global aggregates, file pruning by min/max, joins with duplicate rules, ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side whose rows take at most so many bytes in memory is broadcast; beyond it both sides shuffle.
MAX_BROADCAST_BYTES = 64 << 20
#: What a broadcast row takes besides its columns: its header and its place in the hash table
ROW_BYTES = 64


def in_ranges(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows whose columns lie in all the inclusive ranges; the conjunction reaches the scan as pushed filters."""
    return df.where(reduce(Column.__and__, (F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()), F.lit(True)))


def aggregate(df: DataFrame, **outputs: tuple[str, str]) -> DataFrame:
    """One row of name=(function, column) with min, max or sum; no row for an empty input."""
    found = df.agg(F.count("*").alias("_rows"), *(getattr(F, f)(c).alias(n) for n, (f, c) in outputs.items()))
    return found.where("_rows > 0").drop("_rows")


def chunk_stats(df: DataFrame, chunk: Column, columns: list[str]) -> DataFrame:
    """(chunk, min_c, max_c, ...)"""
    return df.groupBy(chunk.alias("chunk")).agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def prune(stats: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """(chunk): chunks whose intervals overlap all ranges; an equality is a range (v, v)."""
    keep = (((F.col(f"min_{c}") <= hi) & (F.col(f"max_{c}") >= lo)) for c, (lo, hi) in ranges.items())
    return stats.where(reduce(Column.__and__, keep, F.lit(True))).select("chunk")


def one_per_key(df: DataFrame, key: str, seq: str, which: str) -> DataFrame:
    """The first or last row of each key by seq, found with a map-side combine rather than a sort."""
    pick = {"first": F.min_by, "last": F.max_by}[which]
    return df.groupBy(key).agg(pick(F.struct(*(c for c in df.columns if c != key)), seq).alias("_row")).select(key, "_row.*")


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer knows of the size of df, from files and statistics; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def held_bytes(df: DataFrame) -> int:
    """What the rows of df take in a broadcast's hash table. They are counted; files tell little, as they are compressed."""
    wide = (F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind or "char" in kind)
    row = F.lit(ROW_BYTES + 8 * len(df.columns)).cast("long") + reduce(Column.__add__, wide, F.lit(0))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def hash_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, *, duplicates: str = "all", seq: str | None = None, hint: str | None = None) -> DataFrame:
    """Inner equi-join; of build rows with one key all, the first or the last (by seq) match.

    hint: the physical way; without one the sizes decide, at planning and again when the sides are known.
    """
    if duplicates != "all":
        build = one_per_key(build, build_key, seq or build_key, duplicates)
    return (build.hint(hint) if hint else build).join(probe, build[build_key] == probe[probe_key])


def replication_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner join that sends the right side everywhere if its rows are within the bound in memory, and else shuffles both.

    The rows are counted only where the estimate is within the bound too.
    """
    few = estimated_bytes(right) <= MAX_BROADCAST_BYTES and held_bytes(right) <= MAX_BROADCAST_BYTES
    return left.join(F.broadcast(right) if few else right.hint("merge"), left[left_key] == right[right_key])


def semi_join_reduction(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows with a partner; only the right side's keys move."""
    return left.join(right.select(F.col(right_key).alias("_key")), F.col(left_key) == F.col("_key"), "left_semi")


def ranked(df: DataFrame, *order: Column, buckets: Column) -> DataFrame:
    """df with the global `rank` (from 1) by (buckets, order). buckets must be monotone in the order.

    Ranks are counted within each bucket and moved by the rows of the buckets before, so no task sorts all rows; the
    window over all buckets holds one row a bucket.
    """
    parts = df.withColumn("_bucket", buckets)
    sizes = parts.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = parts.join(sizes.select("_bucket", before.alias("_before")), "_bucket")
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return moved.withColumn("rank", (within + F.col("_before")).cast("long")).drop("_bucket", "_before")


def upserted(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by seq."""
    return one_per_key(df, key, seq, "last")


def merged_state(parts: DataFrame, **outputs: tuple[str, str]) -> DataFrame:
    """One row from partial rows of name=(function, column): each function is applied again to its own results."""
    return aggregate(parts, **{n: (f, n) for n, (f, _) in outputs.items()})


def in_two_levels(df: DataFrame, chunk: Column, **outputs: tuple[str, str]) -> DataFrame:
    """aggregate() for each chunk, then over the chunks' results."""
    parts = df.groupBy(chunk).agg(*(getattr(F, f)(c).alias(n) for n, (f, c) in outputs.items()))
    return merged_state(parts, **outputs)
