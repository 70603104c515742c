"""Connected components of a graph given as edges, by alternating large-star and small-star rounds.

Every round is two group-by-and-join steps, whose skewed keys adaptive execution can split; a table in the shared
folder ends each one. The rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


def _to_smallest(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m: the smallest of u and its neighbours v."""
    least = edges.groupBy(F.col("u").alias("lu")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("lu")).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): for each node of an edge between two different nodes, the smallest node it can reach.

    Nodes are longs. Repeated edges, loops and edges with a null end change nothing; without edges the result is empty.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    edges = kept(edges.distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u > v").distinct())
        dropped(edges)
        small = _to_smallest(large)
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = kept(small.where("u > v").distinct())
        dropped(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
