"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: a bit is set if it is set in over half of a text's shingle hashes (XXH64, seed 42).

Links: two fingerprints at `max_bits` differing bits or fewer agree on at least one choice of blocks, so each
distinct fingerprint goes to one top node for each choice: all fingerprints there share those masked bits. Inside a
top node the fingerprints are sorted by Gray rank, and runs of eight are factored again and again into nodes that
hold the bits all their members share. A search walks pairs of nodes from the top; the differences of the shared
bits add up on the way down, and a pair of nodes that exceeds max_bits is dropped with everything below. Nothing is
approximate: each pair within max_bits is found.

A top node of more than MANY * `group` fingerprints is split by blocks of its remaining bits, again so that any two
within max_bits agree on some choice. What is still larger than `group` is cut into parts, and each pair of parts is
a task of its own, so a hot node never meets in one task. Of the links found in a task a spanning forest is returned,
which keeps what is reachable; components() joins the forests.

Scale: equal fingerprints are collapsed first, so thousands of copies cost one row. More blocks are used as the
number of distinct fingerprints grows, which keeps the top nodes small. Texts are read once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import dropped, kept, row_key, sized, table
from .components import components

SEED, BITS, FANOUT = 42, 64, 8
#: Parts beyond which a hot node is split by more of its bits first, and how often
MANY, SPLITS = 32, 2
#: MinHash bands of deduplicated(): texts that agree on all rows of one band are compared
BANDS, ROWS = 20, 6
#: Texts of a band that are compared pair by pair
PAIRED = 64
#: Sets that show what a family of larger bands has in common, about, and how many cores are tried for it
SEEN, CORES = 64, 3
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.array([[[0]], [[1]]], dtype=np.uint64)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()  # bytes are split at exactly U+0009 to U+000D and the space
    if not words:
        return np.empty(0, dtype="<u8")
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes, as a signed long."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, shingle: int) -> int:
    return _majority(_hashes(text, shingle))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(_id, _h, fp): each row's id, the hash of its text and its fingerprint as a signed long. Null texts count as empty."""
    kind = df.select(id_col).schema[0].dataType.simpleString()
    rows = df.select(*row_key(F.col(id_col), F.coalesce(text_col, F.lit(""))), F.encode(F.coalesce(text_col, F.lit("")), "utf-8").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([fingerprint(x.as_py(), shingle) for x in b.column("t")], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_h"), found], names=["_id", "_h", "fp"])

    return rows.mapInArrow(run, f"_id {kind}, _h bigint, fp bigint")


def _block_masks(distinct: int, max_bits: int, crowd: int) -> list[int]:
    """A mask for each choice of blocks: any two fingerprints within max_bits agree under at least one of them."""
    for blocks in range(max_bits + 1, max_bits + 4):
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
        masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
        if distinct >> min(m.bit_count() for m in masks) <= crowd:
            break
    assert len(masks) == comb(blocks, max_bits)
    return [_signed(m) for m in masks]


def _finer_masks(mask: int, max_bits: int) -> list[int]:
    """Masks that hold `mask` and more: any two fingerprints that agree under it and are within max_bits agree under one of these."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    blocks = max_bits + 2
    if len(rest) < blocks:
        return []
    parts = [sum(1 << i for i in rest[len(rest) * b // blocks : len(rest) * (b + 1) // blocks]) for b in range(blocks)]
    masks = [mask | sum(c) for c in combinations(parts, blocks - max_bits)]
    return [_signed(m) for m in masks]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def gray_rank(c: Column) -> Column:
    """The place of a codeword in reflected Gray order (as the bits of a long)."""
    for k in (1, 2, 4, 8, 16, 32):
        c = c.bitwiseXOR(F.shiftrightunsigned(c, k))
    return c


class GrayIndex:
    """Trees over runs of fingerprints in Gray order; `starts` says where each run begins."""

    def __init__(self, fp: np.ndarray, starts: np.ndarray):
        self.ands, self.ors, self.child = [fp], [fp], [None]
        counts = np.diff(np.append(starts, len(fp)))
        while counts.max(initial=1) > 1:
            begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
            place = np.arange(counts.sum()) - np.repeat(begin, counts)
            cut = np.flatnonzero(place % FANOUT == 0)
            self.child.append(np.append(cut, len(place)))
            self.ors.append(np.bitwise_or.reduceat(self.ors[-1], cut))
            self.ands.append(np.bitwise_and.reduceat(self.ands[-1], cut))
            counts = -(-counts // FANOUT)
        self.shared = [~(a ^ o) for a, o in zip(self.ands, self.ors, strict=True)]

    def close(self, level: int, i: np.ndarray, j: np.ndarray, max_bits: int) -> np.ndarray:
        a, m = self.ands[level], self.shared[level]
        return np.bitwise_count((a[i] ^ a[j]) & m[i] & m[j]) <= max_bits

    def pairs(self, i: np.ndarray, j: np.ndarray, max_bits: int, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of fingerprints within max_bits, found below the pairs (i, j) of runs."""
        todo = [(len(self.ands) - 1, i, j)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > step:
                todo += [(level, i[k : k + step], j[k : k + step]) for k in range(0, len(i), step)]
                continue
            near = self.close(level, i, j, max_bits)
            i, j = i[near], j[near]
            if level == 0:
                if len(i):
                    yield i[i != j], j[i != j]
                continue
            at = self.child[level]
            wide, deep = at[i + 1] - at[i], at[j + 1] - at[j]
            size = wide * deep
            of = np.repeat(np.arange(len(i)), size)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            a, b = at[i][of] + nth // deep[of], at[j][of] + nth % deep[of]
            once = (i[of] != j[of]) | (a <= b)
            if once.any():
                todo.append((level - 1, a[once], b[once]))


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes, one node of its component; the same for all of a component."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            a, b = root[a], root[b]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(root, b, a)
            while (root[root] != root).any():
                root = root[root]
    return root


def _linked(rows: pa.Table, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of whole top nodes, sorted by (choice, value, lo, hi, side, Gray rank)."""
    col = {c: rows.column(c).to_numpy() for c in ("choice", "value", "lo", "hi", "side", "fp")}
    fp = col["fp"].view(np.uint64)
    differs = lambda cs: np.concatenate(([True], np.any([col[c][1:] != col[c][:-1] for c in cs], axis=0)))
    node, run = differs(("choice", "value", "lo", "hi")), np.flatnonzero(differs(("choice", "value", "lo", "hi", "side")))
    of_node = np.cumsum(node)[run]
    whole = col["lo"][run] == col["hi"][run]
    own = np.flatnonzero(whole)
    across = np.flatnonzero((of_node[1:] == of_node[:-1]) & ~whole[1:])
    index = GrayIndex(fp, run)
    root = _forest(len(fp), index.pairs(np.concatenate((own, across)), np.concatenate((own, across + 1)), max_bits))
    at = np.flatnonzero(root != np.arange(len(fp)))
    return col["fp"][at], col["fp"][root[at]]


def links(distinct: DataFrame, rows: int, max_bits: int = 3, *, group: int = 1024, crowd: int = 64, max_broadcast: int = 200_000, at_once: int = 200_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` that leave reachable what links within max_bits reach."""
    spread = F.array(*(F.struct(F.lit(m).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for m in _block_masks(rows, max_bits, crowd)))
    keyed = distinct.select("fp", F.explode(spread).alias("k")).select("fp", "k.*")
    sizes = lambda rows: kept(rows.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > group))
    hot = sizes(keyed)
    for _ in range(SPLITS):
        # at most as many rows as there are masks
        masks = [r[0] for r in hot.where(F.col("n") > MANY * group).select("choice").distinct().collect()]
        finer = [(m, f) for m in masks if (f := _finer_masks(m % (1 << BITS), max_bits))]
        if not finer:
            break
        by = hot.where((F.col("n") > MANY * group) & F.col("choice").isin([m for m, _ in finer])).select("choice", "value")
        of = distinct.sparkSession.createDataFrame(finer, "choice long, finer array<bigint>")
        by = sized(by, by.count(), max_broadcast)
        again = keyed.join(by, ["choice", "value"], "left_semi").join(F.broadcast(of), "choice").select("fp", F.explode("finer").alias("choice"))
        again = again.withColumn("value", F.col("fp").bitwiseAND(F.col("choice"))).distinct()
        keyed = kept(keyed.join(by, ["choice", "value"], "left_anti").select("fp", "choice", "value").unionByName(again))
        hot = sizes(keyed)
    if many := hot.count():
        hot = sized(hot, many, max_broadcast)
        keyed = keyed.join(hot, ["choice", "value"], "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / group).cast("int"))
    else:
        keyed = keyed.withColumn("parts", F.lit(1))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    keyed = keyed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("choice", "value", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp")
    node = ["choice", "value", "lo", "hi"]
    ordered = keyed.repartition(*node).sortWithinPartitions(*node, "side", gray_rank(F.col("fp")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: pa.Table) -> pa.RecordBatch:
            a, b = _linked(rows, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= at_once:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = rows.slice(rows.num_rows - 1).to_pylist()[0]
                same = np.all([rows.column(c).to_numpy() == last[c] for c in node], axis=0)
                cut = int(np.argmax(same))  # the last top node may go on
                if cut:
                    yield edges(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield edges(rows.combine_chunks())

    return ordered.mapInArrow(run, "a bigint, b bigint")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(_id, _h, fp, component): for each row its fingerprint and the smallest id reachable over links, its own included.

    Null texts count as empty, and texts without words have fingerprint 0, linked like any other. Repeated rows have
    the same class; a null id has one too, and only a class of null ids alone is null. An empty table gives an empty
    result; other columns of df are ignored.
    """
    prints = kept(fingerprints(df, id_col, text_col, shingle))
    distinct = kept(prints.groupBy("fp").agg(F.min("_id").alias("least")))
    found = components(links(distinct, distinct.count(), max_bits))
    found = kept(found)
    members = found.join(distinct, found["node"] == distinct["fp"])
    smallest = members.groupBy("label").agg(F.min("least").alias("smallest"))
    named = found.join(smallest, "label").select(F.col("node"), "smallest")
    by_print = kept(distinct.join(named, distinct["fp"] == named["node"], "left").select(distinct["fp"].alias("of"), F.coalesce("smallest", "least").alias("component")))
    # both sides come from tables, so that a fingerprint with very many rows can be split
    return prints.join(by_print, prints["fp"] == by_print["of"]).select("_id", "_h", "fp", "component")


def _band_keys(shingles: np.ndarray) -> list[int]:
    """A key for each band of a text's MinHash signature, as signed longs."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max, dtype="<u8")
    for i in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, ((shingles[i : i + (1 << 12)] ^ _XOR) * _ODD).min(axis=1, keepdims=True))
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[b * 8 * ROWS : (b + 1) * 8 * ROWS], seed=b) for b in range(BANDS)]
    return [k - (1 << BITS) if k >> (BITS - 1) else k for k in keys]


def _sets(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """df with _row (a number of its own), _h, fp, the shingle set's hash `node`, its size `width` and its band keys."""
    rows = df.withColumn("_h", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    out = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in (("fp", LongType()), ("node", LongType()), ("width", LongType()), ("keys", ArrayType(LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _few(batches, text_col):
            fp, node, width, keys = [], [], [], []
            for text in texts:
                hashes = _hashes(text, shingle)
                found = np.unique(hashes)
                fp.append(_majority(hashes))
                node.append(int(np.array([xxhash.xxh64_intdigest(found.tobytes())], dtype="<u8").view("<i8")[0]))
                width.append(len(found))
                keys.append(_band_keys(found) if len(found) else [])
            more = [pa.array(x, pa.int64()) for x in (fp, node, width)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(keys, pa.list_(pa.int64()))], names=out.names)

    return kept(rows.mapInArrow(run, out).withColumn("_row", F.monotonically_increasing_id()))


def _few(batches: Iterator[pa.RecordBatch], text_col: str, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batches in parts of a few rows, with their texts as UTF-8; null texts count as empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, [x or b"" for x in part.column(text_col).cast(pa.binary()).to_pylist()]


def _shingled(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(node, shingles): the sorted distinct shingle hashes of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _few(batches, text_col):
            held = pa.array([np.unique(_hashes(t, shingle)).view("<i8") for t in texts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("node"), held], names=["node", "shingles"])

    return rows.select("node", text_col).mapInArrow(run, "node bigint, shingles array<bigint>")


def _alike(pairs: DataFrame, sets: DataFrame, text_col: str, shingle: int, similarity: float, max_broadcast: int) -> DataFrame:
    """The pairs (a, b), with the widths wa and wb of their sets, whose shingle sets have at least this Jaccard similarity.

    A pair whose widths alone rule it out isn't asked; only the texts of the others are read again.
    """
    pairs = pairs.where((F.col("a") != F.col("b")) & (F.try_divide(F.least("wa", "wb"), F.greatest("wa", "wb")) >= similarity))
    pairs = kept(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    asked = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = kept(_shingled(sets.join(sized(asked, asked.count(), max_broadcast), "node", "left_semi"), text_col, shingle))
    both = pairs.join(held.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(held.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    found = kept(both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b"))
    dropped(pairs, asked, held)
    return found


def _groups(rows: DataFrame, text_col: str, shingle: int, similarity: float, max_bits: int, max_broadcast: int) -> DataFrame:
    """(node, label) for the shingle sets that are linked to another one, by Jaccard similarity."""
    one = kept(rows.groupBy("node").agg(F.min("_row").alias("_row")))
    many = one.count()
    sets = rows.join(sized(one.select("_row"), many, max_broadcast), "_row", "left_semi")
    keyed = sets.select("node", "width", F.explode("keys").alias("key"))
    first = F.min(F.struct("node", "width"))
    least = kept(keyed.groupBy("key").agg(first.alias("x"), F.count("*").alias("n")).where("n > 1").select("key", F.col("x.node").alias("least"), F.col("x.width").alias("w")))
    members = kept(keyed.join(sized(least, least.count(), max_broadcast), "key").where("node <> least"))
    of_print = kept(sets.groupBy("fp").agg(first.alias("x")).select("fp", F.col("x.node").alias("least"), F.col("x.width").alias("w")))
    near = links(of_print.select("fp"), of_print.count(), max_bits)
    near = near.join(of_print.toDF("a", "na", "wa"), "a").join(of_print.toDF("b", "nb", "wb"), "b").select(F.col("na").alias("a"), "wa", F.col("nb").alias("b"), "wb")
    equal = sets.select("fp", "node", "width").join(of_print, "fp")
    to_least = lambda df: df.select(F.col("least").alias("a"), F.col("w").alias("wa"), F.col("node").alias("b"), F.col("width").alias("wb"))
    sure = _alike(to_least(members).unionByName(near).unionByName(to_least(equal)), sets, text_col, shingle, similarity, max_broadcast)
    found = kept(components(sure))
    # a bucket's members were compared with its smallest one; a bucket that this hasn't joined is compared pair by pair
    # if it is small, and the members of larger ones are searched by how they differ from what most of them share
    named = kept(members.join(found, "node", "left").select("key", "node", "width", F.coalesce("label", "node").alias("label")))
    open_ = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    named = kept(named.join(open_, "key"))
    few = named.where(F.col("n") <= PAIRED).select("key", "node", "width", "label")
    a, b = few.toDF("key", "a", "wa", "la"), few.toDF("key", "b", "wb", "lb")
    rest = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (F.try_divide(F.least("wa", "wb"), F.greatest("wa", "wb")) >= similarity)).select("a", "wa", "b", "wb")
    many = named.where(F.col("n") > PAIRED)
    if not many.isEmpty():
        family = components(many.select("key", "node"), "key", "node").withColumnRenamed("label", "family")
        many = kept(many.select("node", "label").distinct().join(family, "node"))
        rest = rest.unionByName(_framed_pairs(many, sets, text_col, shingle, similarity, max_broadcast))
    return components(sure.unionByName(_alike(rest, sets, text_col, shingle, similarity, max_broadcast)))


def _cores(held: DataFrame, max_broadcast: int) -> DataFrame:
    """(family, core): the shingles that stand in over half of a family's sets, judged by about SEEN of them."""
    size = kept(held.groupBy("family").agg(F.count("*").alias("n")))
    some = held.join(sized(size, size.count(), max_broadcast), "family").where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.col("n") / SEEN).cast("long")) == 0)
    each = some.select("family", F.explode("shingles").alias("t")).groupBy("family", "t").agg(F.count("*").alias("n"))
    half = some.groupBy("family").agg((F.count("*") / 2).alias("half"))
    return each.join(sized(half, size.count(), max_broadcast), "family").where("n > half").groupBy("family").agg(F.collect_list("t").alias("core"))


def _framed_pairs(named: DataFrame, sets: DataFrame, text_col: str, shingle: int, similarity: float, max_broadcast: int) -> DataFrame:
    """(a, wa, b, wb): pairs of nodes (node, label, family) of one family; they link what all similar pairs with different labels link.

    A set is taken as how it differs from its family's core: p shingles, of which it lacks x, and it has y others. With
    r = s / (1 + s), two sets have at least similarity s if and only if their differences share at least c + c' of
    these, where c = (1 - r) x + r y - (1 - 2 r) p / 2. This holds for any core, so all that depends on it is the time.

    * c + c' <= 0: near without sharing any. Both are then near the set with the smallest c too, and are paired with it.
    * c + c' > 0: they share a difference, and the first that they share, the rarest first, leaves enough behind it in
      both. Differences of one set alone can't be shared, so texts that were each edited in their own way are told
      apart by their numbers.

    Sets that differ from the core by as much as they are large are compared among each other with a core of their own.
    """
    held = _shingled(sets.join(sized(named.select("node"), named.count(), max_broadcast), "node", "left_semi"), text_col, shingle)
    held = kept(held.join(named, "node"))
    r = similarity / (1 + similarity)
    out, none, slack = [], F.array().cast("array<bigint>"), 1e-6
    for left in reversed(range(CORES)):
        core = kept(_cores(held, max_broadcast))
        total = core.agg(F.sum(F.size("core"))).first()[0] or 0
        own = held.join(sized(core, total, max_broadcast), "family", "left").withColumn("core", F.coalesce("core", none))
        own = own.withColumns({"lacks": F.array_except("core", "shingles"), "adds": F.array_except("shingles", "core"), "w": F.size("shingles").cast("long")})
        c = F.size("lacks") * (1 - r) + F.size("adds") * r - F.size("core") * ((1 - 2 * r) / 2)
        own = own.select("node", "label", "family", "w", c.alias("c"), F.concat("lacks", "adds").alias("ts"))
        own = kept(own.withColumn("near", F.size("ts") < F.col("w")))
        first = own.groupBy("family").agg(F.min(F.struct("c", "node", "w")).alias("x")).select("family", F.col("x.c").alias("c0"), F.col("x.node").alias("a"), F.col("x.w").alias("wa"))
        first = kept(first)
        star = own.join(sized(first, first.count(), max_broadcast), "family").where(F.col("c") + F.col("c0") <= slack)
        out.append(kept(star.where("node <> a").select("a", "wa", F.col("node").alias("b"), F.col("w").alias("wb"))))
        # labels that the star joins are one from here on
        joined = kept(star.select("family", "label", F.col("a").alias("of")).distinct())
        own = own.join(sized(joined, joined.count(), max_broadcast), ["family", "label"], "left").withColumn("label", F.coalesce("of", "label"))
        last = left == 0 or own.where("near").isEmpty()
        out.append(kept(_sharing(own, first, similarity, slack, max_broadcast, last)))
        far = own.where("not near").select("node", "label", "family")
        if last or far.isEmpty():
            break
        held = kept(held.drop("label", "family").join(far, "node"))
    return reduce(DataFrame.unionByName, out)


def _sharing(own: DataFrame, first: DataFrame, similarity: float, slack: float, max_broadcast: int, far_too: bool) -> DataFrame:
    """(a, wa, b, wb) of _framed_pairs() that share a difference; far_too: also those of two sets that aren't near."""
    each = own.select("node", "family", F.explode("ts").alias("t"))
    times = each.groupBy("family", "t").agg(F.count("*").alias("n")).where("n > 1")
    shared = each.join(times, ["family", "t"]).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("ts"))
    own = own.drop("ts").join(shared, "node").join(sized(first.select("family", "c0"), first.count(), max_broadcast), "family")
    # the place of each from behind, as far as it can be the first shared: with sets of no larger c, with those of no smaller c
    places = F.transform("ts", lambda x, i: F.struct(x["t"].alias("t"), (F.size("ts") - i).alias("left")))
    least = lambda c: F.filter(places, lambda x: x["left"] + slack >= c)
    own = kept(own.select("node", "label", "family", "w", "c", "near", least(F.col("c") + F.col("c0")).alias("outer"), least(2 * F.col("c")).alias("inner")))
    part = lambda places, n: own.select("family", *(F.col(x).alias(x + n) for x in ("node", "label", "w", "c", "near")), F.inline(places)).withColumnRenamed("left", "left" + n)
    a, b = part("inner", "a"), part("outer", "b")
    fits = (F.col("labela") != F.col("labelb")) & (F.struct("ca", "nodea") < F.struct("cb", "nodeb")) & (F.least("lefta", "leftb") + slack >= F.col("ca") + F.col("cb"))
    fits = fits & (F.col("ca") + F.col("cb") > slack) & (F.least("wa", "wb") / F.greatest("wa", "wb") >= similarity)
    if not far_too:
        fits = fits & (F.col("neara") | F.col("nearb"))
    return a.join(b, ["family", "t"]).where(fits).select(F.col("nodea").alias("a"), "wa", F.col("nodeb").alias("b"), "wb")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, max_bits: int = 3, max_broadcast: int = 500_000) -> DataFrame:
    """df's rows without near-duplicates: of each class the row with the smallest (id, hash of text) stays, once.

    Two texts are linked if the Jaccard similarity of their sets of `shingle` words is at least `similarity`; a class
    is what links reach. Candidates are texts that share a band of their MinHash signature or whose fingerprints link
    within max_bits; each is confirmed by the exact similarity. A band's texts are compared with one of them, and where
    that leaves some apart, with each other: pair by pair up to PAIRED texts, beyond that by how they differ from what most
    of them share. A band is missed with the probability
    (1 - s^ROWS)^BANDS, 0.2 % at s = 0.8. Null texts count as empty, and all texts without words are one class. A null
    id comes after all others.
    """
    plain = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    rows = _sets(df.select(*(F.col(f"`{c}`").alias(n) for c, n in plain.items())), plain[text_col], shingle)
    groups = kept(_groups(rows, plain[text_col], shingle, similarity, max_bits, max_broadcast))
    of = rows.select("_row", F.col(plain[id_col]).alias("_id"), "_h", "node").join(sized(groups, groups.count(), max_broadcast), "node", "left")
    of = kept(of.select("_row", "_id", "_h", F.coalesce("label", "node").alias("label")))
    first = of.groupBy("label").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_h", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = kept(first.select("label", F.col("first._row").alias("stays")))
    extra = kept(of.join(sized(first, first.count(), max_broadcast), "label").where("_row <> stays").select("_row"))
    return rows.join(sized(extra, extra.count(), max_broadcast), "_row", "left_anti").select(*(F.col(n).alias(c) for c, n in plain.items()))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = classes(table(spark, folder, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
