"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size is the mean number of copies of its documents. The whole part is taken of every
document; the fraction is an inclusion probability. The flight phase of the cube method moves the probabilities
along the null space of the balancing constraints (documents and words of the source) until all but a few are 0 or 1;
long documents fly first.
Flights run in blocks of about `block` documents of one source; what a block leaves undecided (at most as many
documents as there are constraints, and a few of all sizes that wait) flies again with the rest of other blocks, and
so on, until one block a source is left. There a few documents of all sizes don't fly; with the last open ones they
are the landing problem: of the NEAREST choices in words one is drawn, with the weight that independent draws would
give it. So all inclusion probabilities hold through the flight, and those of at most LANDED + 2 documents a source
nearly so after it.

Scale: texts are read once, to count words; then only ids and numbers move. Equal rows are one row with their number,
and a source with a third of all documents is cut into blocks like any other. Blocks and the order within them come
from hashes of the rows, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, kept, table

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
_EPS = 1e-9
#: Documents that the last block keeps for the landing (with the two that a flight leaves open, 2^14 choices), and how
#: many of the nearest choices are drawn from
LANDED, NEAREST = 12, 16
#: Documents that a block of many leaves to the next round, besides the two that its flight leaves open
PASSED_ON = 64
#: A document of so many times the words that an open one is expected to add is decided before the last flight
BIG = 10


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size): all sizes shared by weight, repeating over sources in code
    point order with null last; a target stops at `most` times its source's size and the rest is shared anew.

    The level at which all sources stop is found in closed form: ordered by the level that fills them, the first k
    are full where the rest, at what remains a unit of weight, isn't. The windows below hold one row a source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("fits", F.col("cap") >= F.col("w") * F.col("level"))
    nth = F.row_number().over(Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()))
    first = F.min(F.when(F.col("fits"), F.struct("nth", "level"))).over(every)
    rows = rows.withColumn("nth", nth).withColumn("level", first["level"])
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def _step(p: list[float], x: list[list[float]], u: float) -> None:
    """Moves the probabilities p of three documents along the null space of their two constraints, in place."""
    (a1, b1), (a2, b2), (a3, b3) = x
    d = [a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1]
    if max(map(abs, d)) < 1e-12:  # the sizes are equal: one constraint says it all
        d = [a2, -a1, 0.0]
    _move(p, d, u)


def _move(p: list[float], d: list[float], u: float) -> None:
    """Moves p along d, forth or back, until one of them is 0 or 1; the chances are such that the means of p stay."""
    up = min(((1 - q) / v if v > 0 else -q / v) for q, v in zip(p, d, strict=True) if abs(v) > 1e-12)
    down = min((q / v if v > 0 else (q - 1) / v) for q, v in zip(p, d, strict=True) if abs(v) > 1e-12)
    by = up if u * (up + down) < down else -down
    for i, v in enumerate(d):
        q = p[i] + by * v
        p[i] = 0.0 if q < _EPS else 1.0 if q > 1 - _EPS else q


def flight(p: list[float], size: list[float], u: list[float]) -> list[float]:
    """The probabilities after a flight that keeps sum(p) and sum(p * size); at most two stay undecided.

    These are the cube method's constraints on the number of documents and of words that are taken. u: a uniform
    number for each row.
    """
    out, mean = list(p), max(sum(size) / max(len(size), 1), 1.0)
    live: list[int] = []
    for i, q in enumerate(p):
        if _EPS < q < 1 - _EPS:
            live.append(i)
        while len(live) == 3:
            now = [out[j] for j in live]
            _step(now, [[1.0, size[j] / mean] for j in live], u[i])
            for j, v in zip(live, now, strict=True):
                out[j] = v
            rest = [j for j in live if 0 < out[j] < 1]
            if len(rest) == 3:  # rounding kept it from an edge
                j = min(rest, key=lambda j: min(out[j], 1 - out[j]))
                out[j] = round(out[j])
                rest.remove(j)
            live = rest
    return out


def settled(p: list[float], size: list[int], u: float) -> list[float]:
    """p with the documents decided, by systematic sampling, that have over BIG times the mean of the expected words.

    A flight would carry them open to its end, where no few others can balance them. What they take too much or too
    little is given to the other open documents' probabilities, which keep their means, as it is 0 in the mean.
    """
    q, words = np.array(p), np.array(size, float)
    open_ = (q > _EPS) & (q < 1 - _EPS)
    big = open_ & (words * open_.sum() > BIG * (q[open_] @ words[open_]))
    if not big.any() or open_.sum() - big.sum() <= LANDED:
        return p
    sums = np.concatenate(([0.0], np.cumsum(q[big]))) + u
    taken = np.diff(np.floor(sums))
    over = (taken - q[big]) @ words[big]
    q[big] = taken
    rest = open_ & ~big
    room = q[rest] * (1 - q[rest])
    if room @ words[rest] > 0:
        q[rest] = np.clip(q[rest] - room * over / (room @ words[rest]), 0.0, 1.0)
    return q.tolist()


def landing(p: list[float], size: list[int], u: float) -> list[float]:
    """Decides the last documents: of the choices whose words, then number, come nearest to what is expected one is drawn by u."""
    open_at = [i for i, q in enumerate(p) if 0 < q < 1]
    if not open_at:
        return p
    sizes, probs = np.array([size[i] for i in open_at], float), np.array([p[i] for i in open_at])
    choices = (np.arange(1 << len(open_at))[:, None] >> np.arange(len(open_at))) & 1
    words, docs = np.abs(choices @ sizes - probs @ sizes).round(6), np.abs(choices.sum(axis=1) - probs.sum())
    near = choices[np.lexsort((docs, words))[: min(NEAREST, 1 << (len(open_at) // 2))]]
    weight = np.where(near, probs, 1 - probs).prod(axis=1).cumsum()
    best = near[int(np.searchsorted(weight, u * weight[-1], side="right").clip(0, len(near) - 1))]
    out = list(p)
    for i, v in zip(open_at, best, strict=True):
        out[i] = float(v)
    return out


def _waiting(open_at: list[int], n: int) -> set[int]:
    """About n of the open documents, from all sizes."""
    every = max(1, -(-len(open_at) // n))
    return set(open_at[every // 2 :: every])


def _fly(rows: pd.DataFrame, passed_on: int) -> pd.DataFrame:
    """One block's flight. The only block of a source lands; others leave a few documents of all sizes to the next round."""
    rows, last = rows.sort_values(["size", "key"], ascending=[False, True], kind="stable"), rows["blocks"].iloc[0] == 1
    p, size, u, chance = rows["p"].tolist(), rows["size"].tolist(), rows["u"].tolist(), rows["u_last"].iloc[-1]
    plain = lambda q: q if _EPS < q < 1 - _EPS else float(round(q))
    if last:
        p = settled(p, size, chance)
    waits = _waiting([i for i, q in enumerate(p) if _EPS < q < 1 - _EPS], LANDED if last else passed_on)
    fly = [i for i in range(len(p)) if i not in waits]
    for i, q in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], [u[i] for i in fly]), strict=True):
        p[i] = plain(q)
    return rows.assign(p=landing(p, size, chance) if last else p)


def sampled(rows: DataFrame, most: int, block: int = 4096) -> DataFrame:
    """rows (stratum, blocks, key, size, p, u, u_last, ...) with p decided to be 0 or 1, balanced on rows and sizes of each stratum.

    blocks: among how many blocks the stratum's rows are dealt; most: the greatest such number.
    """
    passed_on = min(PASSED_ON, block // 8)
    assert passed_on > 1, "blocks of 16 documents or more"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    done: DataFrame | None = None
    while True:
        keyed = rows.withColumn("block", F.pmod(F.xxhash64("key", F.lit(most)), F.col("blocks")))
        flown = kept(keyed.groupBy("stratum", "block").applyInPandas(lambda b: _fly(b, passed_on), f"{kinds}, block bigint")).drop("block")
        decided = flown.where("p = 0 OR p = 1")
        done = decided if done is None else done.unionByName(decided)
        if most == 1:
            return done
        # a block leaves two open documents and about passed_on waiting ones
        rows = flown.where("p > 0 AND p < 1").withColumn("blocks", F.ceil(F.col("blocks") * (passed_on + 3) / block).cast("long"))
        most = -(-most * (passed_on + 3) // block)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, block: int = 4096) -> DataFrame:
    """(_id, _h, source, size, source_size, target, copies, n): how often the mix takes the n rows of one id, text and source together.

    size counts words. Null texts have size 0; a null source is a source of its own, the last. Rows may repeat or have
    null ids: the hash of id and text names them. No row is taken more than `most` times. Without words in a source
    nothing is taken of it. An empty table gives an empty result; other columns of df are ignored.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = kept(rows.groupBy("_id", "_h", "source", "size").agg(F.count("*").alias("n")))
    shares = targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    counts = rows.groupBy("source").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")).withColumnRenamed("source", "_s")
    shares = shares.join(counts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shares = kept(shares.withColumn("stratum", F.xxhash64(F.col("source").isNull(), F.col("source"))).withColumn("mean", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    rows = rows.withColumn("stratum", F.xxhash64(F.col("source").isNull(), F.col("source"))).join(shares.drop("source"), "stratum")
    mean = F.col("n") * F.least(F.col("mean"), F.lit(float(most)))
    whole = F.floor(mean + _EPS)
    key = F.xxhash64("_id", "_h", "source", "size")
    chance = lambda name: F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.withColumns({"whole": whole, "p": F.greatest(mean - whole, F.lit(0.0)), "key": key, "u": chance("u"), "u_last": chance("last")})
    # without rows there is nothing to fly
    out = sampled(rows.drop("mean"), shares.agg(F.max("blocks")).first()[0] or 1, block)
    return out.select("_id", "_h", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).cast("long").alias("copies"), "n")


def dealt(mixed: DataFrame) -> DataFrame:
    """mix()'s result with a row for each row of the input: `nth` (from 1) and its own `copies`, as even as can be."""
    rows = mixed.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.withColumn("copies", F.expr("copies div n") + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = dealt(mix(table(spark, folder, "documents")))
    return out.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op6_mixing": op6_mixing}
