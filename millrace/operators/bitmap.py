"""Bitmap indexes as rows (value, word, bits): 64 row ids to a word, built with a map-side bit_or."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def _word(row_id: str) -> Column:
    return F.shiftright(F.col(row_id).cast("long"), 6)


def naive(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """(value, word, bits): for each value the bits of its rows."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(row_id), F.lit(WORD)).cast("int"))
    return df.groupBy(F.col(value).alias("value"), _word(row_id).alias("word")).agg(F.bit_or(bit).alias("bits"))


def lookup(index: DataFrame, lo: int, hi: int) -> DataFrame:
    """(word, bits) of the rows with a value in the inclusive range; none if lo > hi."""
    return index.where(F.col("value").between(lo, hi)).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def range_encoded(df: DataFrame, value: str, row_id: str) -> DataFrame:
    """(value, word, bits): for each value the bits of the rows with that value or a higher one.

    A word has a row for each value that stands in it; a value in between has the bits of the next higher one. The
    window holds the values of one word, at most 64 rows.
    """
    above = Window.partitionBy("word").orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return naive(df, value, row_id).withColumn("bits", F.bit_or("bits").over(above))


def range_encoded_lookup(index: DataFrame, lo: int, hi: int) -> DataFrame:
    """(word, bits) of the rows in the range: those of at least lo without those above hi; none if lo > hi."""
    if lo > hi:
        return index.select("word", "bits").limit(0)
    zero = F.lit(0).cast("long")
    at_least = F.coalesce(F.min_by(F.when(F.col("value") >= lo, F.col("bits")), F.when(F.col("value") >= lo, F.col("value"))), zero)
    above = F.coalesce(F.min_by(F.when(F.col("value") > hi, F.col("bits")), F.when(F.col("value") > hi, F.col("value"))), zero)
    return index.where(F.col("value") >= lo).groupBy("word").agg(at_least.bitwiseAND(F.bitwise_not(above)).alias("bits")).where("bits <> 0")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, bits) of the rows in a or b."""
    return a.select("word", "bits").unionByName(b.select("word", "bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, bits) of the rows in a and b; each holds a word once."""
    other = b.select(F.col("word").alias("_w"), F.col("bits").alias("_b"))
    return a.join(other, F.col("word") == F.col("_w")).select("word", F.col("bits").bitwiseAND(F.col("_b")).alias("bits")).where("bits <> 0")


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, bits) of the rows in a and not in b; each holds a word once."""
    other = b.select(F.col("word").alias("_w"), F.col("bits").alias("_b"))
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("long"))))
    return a.join(other, F.col("word") == F.col("_w"), "left").select("word", left.alias("bits")).where("bits <> 0")


def _whole(value: Column, by: int) -> Column:
    """value div by, without a detour over doubles."""
    return ((value.cast("long") - F.pmod(value.cast("long"), F.lit(by))).cast("decimal(20,0)") / F.lit(by).cast("decimal(20,0)")).cast("long")


def digit_count(highest: int, base: int) -> int:
    """How many digits the highest value has; 0 has one."""
    n = 1
    while highest >= base:
        highest, n = highest // base, n + 1
    return n


def optimal_base() -> int:
    """The base of a decomposed index where nothing is known of the queries (fixed value)."""
    return 5


def digits(value: Column, base: int, highest: int) -> list[Column]:
    """The digits of value, the lowest first, as many as the highest value has."""
    out, power = [], 1
    while not out or power <= highest:
        out.append(F.pmod(_whole(value, power), F.lit(base)))
        power *= base
    return out


def decomposed(df: DataFrame, value: str, row_id: str, base: int, highest: int) -> DataFrame:
    """(place, digit, word, bits)"""
    parts = F.array(*(F.struct(F.lit(i).alias("place"), d.alias("digit")) for i, d in enumerate(digits(F.col(value), base, highest))))
    rows = df.select(row_id, F.explode(parts).alias("d")).select(row_id, "d.place", "d.digit")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(row_id), F.lit(WORD)).cast("int"))
    return rows.groupBy("place", "digit", _word(row_id).alias("word")).agg(F.bit_or(bit).alias("bits"))


def decomposed_lookup(index: DataFrame, lo: int, hi: int, base: int, highest: int) -> DataFrame:
    """(word, bits) of the rows in the range, from the digits' bitmaps: not above hi, and not below lo."""
    lo, hi, zero = max(lo, 0), min(hi, highest), F.lit(0).cast("long")
    if lo > hi:
        return index.select("word", "bits").limit(0)
    places = len(digits(F.lit(0), base, highest))

    def any_of(place: int, digit: Column) -> Column:
        return F.bit_or(F.when((F.col("place") == place) & digit, F.col("bits")))

    sides, pick = [], F.col("digit")
    for i in range(places):
        low, high = lo // base**i % base, hi // base**i % base
        sides += [any_of(i, pick > low).alias(f"gl{i}"), any_of(i, pick == low).alias(f"el{i}"), any_of(i, pick < high).alias(f"lh{i}"), any_of(i, pick == high).alias(f"eh{i}")]
    rows = index.groupBy("word").agg(*sides)
    at = lambda n: F.coalesce(F.col(n), zero)
    least, most = F.lit(-1).cast("long"), F.lit(-1).cast("long")
    for i in range(places):  # from the lowest digit up
        least = at(f"gl{i}").bitwiseOR(at(f"el{i}").bitwiseAND(least))
        most = at(f"lh{i}").bitwiseOR(at(f"eh{i}").bitwiseAND(most))
    return rows.select("word", least.bitwiseAND(most).alias("bits")).where("bits <> 0")


def digit_counts(index: DataFrame) -> DataFrame:
    """(place, digit, n): how many rows have the digit at that place."""
    return index.groupBy("place", "digit").agg(F.sum(F.bit_count("bits")).alias("n"))


def row_ids(words: DataFrame) -> DataFrame:
    """(row_id) of the set bits."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.col("bits").bitwiseAND(bit(i)) != 0)
    return words.select("word", F.explode(places).alias("place")).select((F.col("word") * WORD + F.col("place")).cast("long").alias("row_id"))
