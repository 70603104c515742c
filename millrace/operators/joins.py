"""Joins by placement: radix buckets, both sides dealt by key, one side dealt to the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .relational import one_per_key


def radix_join(build: DataFrame, probe: DataFrame, build_key: str, probe_key: str, *, seq: str | None = None, bits: int | None = None) -> DataFrame:
    """Inner equi-join of whole-number keys over radix buckets; of build rows with one key the first by seq matches.

    Both sides are dealt to 2^bits buckets by the low bits of the key, so a bucket of the build side is as large as
    `bits` makes it; bits: from the rows of the build side, which are then counted.
    """
    build = one_per_key(build, build_key, seq or build_key, "first")
    bits = exchange.radix_bits(build.count()) if bits is None else bits
    left = exchange.radix_partitioned(build, build_key, bits).withColumnRenamed("bucket", "_b")
    right = exchange.radix_partitioned(probe, probe_key, bits)
    return left.join(right, (F.col("_b") == F.col("bucket")) & (left[build_key] == right[probe_key])).drop("_b", "bucket")


def symmetric_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, peers: int) -> DataFrame:
    """Inner equi-join with both sides dealt to the peer of their key, the modulo; the join adds no exchange."""
    a = exchange.placed(left, left_key, peers, "_pa")
    b = exchange.placed(right, right_key, peers, "_pb")
    return a.join(b, (F.col("_pa") == F.col("_pb")) & (a[left_key] == b[right_key])).drop("_pa", "_pb")


def asymmetric_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join to a left side that lies by its key (exchange.dealt); only the right side moves to it."""
    return left.join(right.hint("shuffle_hash"), left[left_key] == right[right_key])
