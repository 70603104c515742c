"""Placement of rows by key: exact modulo partitions, radix buckets, replication."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What sizes the buckets of a radix join (fixed values): bytes a build row needs, bytes of cache, the most bits.
BYTES_A_ROW, CACHE, MOST_BITS = 65, 24 * 1024 * 1024 // 8, 16


def radix_bits(rows: int) -> int:
    """The fewest low bits that split the build side into buckets that fit the cache."""
    return next((b for b in range(MOST_BITS) if BYTES_A_ROW * rows <= CACHE << b), MOST_BITS)


def modulo(key: Column, peers: int) -> Column:
    """The peer of a key, not negative for negative keys."""
    return F.pmod(key, F.lit(peers))


def repartitioned(df: DataFrame, key: str, peers: int) -> DataFrame:
    """df with each row in the partition of its key's modulo."""
    return df.repartitionById(peers, modulo(F.col(key), peers).cast("int"))


def placed(df: DataFrame, key: str, peers: int, peer: str = "peer") -> DataFrame:
    """df with the number of its peer, and each row in that partition."""
    return df.withColumn(peer, modulo(F.col(key), peers).cast("int")).repartitionById(peers, F.col(peer))


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """df hashed by key once; joins on that key with as many partitions don't move it again."""
    return df.repartition(parts, key)


def radix_partitioned(df: DataFrame, key: str, bits: int) -> DataFrame:
    """df with its `bucket`, the low bits of the key, and each row in that partition."""
    bucket = F.col(key).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return df.withColumn("bucket", bucket).repartitionById(1 << bits, F.col("bucket"))


def node_of(key: Column, partitions: int, nodes: int) -> Column:
    """The node of a key: its partition by modulo, then the node of that partition. Keys are read as unsigned."""
    unsigned = F.when(key < 0, key.cast("decimal(20,0)") + F.lit(_WHOLE)).otherwise(key.cast("decimal(20,0)"))
    return F.pmod(F.pmod(unsigned, F.lit(partitions)).cast("int"), F.lit(nodes))


def shuffled(df: DataFrame, key: str, partitions: int, nodes: int) -> DataFrame:
    """df with the `node` of each row, in the partition of that number: one exchange does what two levels decide."""
    return df.withColumn("node", node_of(F.col(key), partitions, nodes).cast("int")).repartitionById(nodes, F.col("node"))


#: 2^64, beyond a long
_WHOLE = Decimal(1 << 64)

#: What spreads keys over a power of two of slots (fixed value: 2^64 over the golden ratio, as a signed long)
SPREAD = 0x9E3779B97F4A7C15 - (1 << 64)


def slot(key: Column, slots: int) -> Column:
    """The slot of a key in a table of a power of two: the upper half of its product with SPREAD, cut to the table.

    The product is taken in two halves, so that no step exceeds a long.
    """
    mask = (1 << 32) - 1
    low, high = key.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(key, 32)
    s_low, s_high = SPREAD & mask, (SPREAD >> 32) & mask
    half = lambda a, b: F.pmod(a.cast("decimal(20,0)") * F.lit(b).cast("decimal(10,0)"), F.lit(_WHOLE))
    upper = F.floor(half(low, s_low) / F.lit(1 << 32).cast("decimal(20,0)")) + half(low, s_high) + half(high, s_low)
    return F.pmod(upper, F.lit(slots)).cast("long")


def replicated(df: DataFrame, peers: int) -> DataFrame:
    """Each row once for each `peer`."""
    return df.withColumn("peer", F.explode(F.sequence(F.lit(0), F.lit(peers - 1))))


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def offsets(counts: DataFrame) -> DataFrame:
    """counts with each bucket's first place; the window holds one row a bucket."""
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("first_place", F.coalesce(before, F.lit(0)).cast("long"))
