"""A unique key as a layout: Parquet files in ranges of the key, sorted inside, so a lookup reads the row groups it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import in_ranges, upserted


def build(df: DataFrame, key: str, path: str, *, parts: int, seq: str | None = None) -> None:
    """Writes the last row of each key (by seq; any, if None) in ranges of the key."""
    rows = upserted(df, key, seq or key)
    rows.repartitionByRange(parts, key).sortWithinPartitions(key).write.parquet(path)


def insert(spark: SparkSession, path: str, rows: DataFrame, key: str, into: str, *, parts: int) -> None:
    """Writes the layout at `into`: what is at `path`, with rows put in or in place of those with their keys."""
    old = spark.read.parquet(path)
    rows = rows.select(*old.columns)
    old.join(rows.select(key), key, "left_anti").unionByName(rows).repartitionByRange(parts, key).sortWithinPartitions(key).write.parquet(into)


def lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key, or none."""
    return in_ranges(df, {key: (value, value)})


def range_lookup(df: DataFrame, key: str, lo: object, hi: object) -> DataFrame:
    """The rows of the inclusive range with their `rank` by key, from 1; none if lo > hi. The window holds the range's rows."""
    return in_ranges(df, {key: (lo, hi)}).withColumn("rank", F.row_number().over(Window.orderBy(key)).cast("long"))
