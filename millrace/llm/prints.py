"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they stand in it. For sample k each term draws from its own hash
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the term of least ln c - r (t - b + 1) is sampled as
(term, t). Two signatures agree in a sample with a probability equal to the generalised Jaccard similarity of their
weighted terms, sum(min) / sum(max). The share of equal samples estimates it with a standard error of at most
0.5 / sqrt(samples).

The query compares a text with its successor by id and with an edited text that takes from it. Rows are dealt by
ranges of ids, cut at quantiles; the first row of each range is also sent to the range before it, so each row
meets its successor in one shuffle, without a window over all rows.

Scale: a fingerprint needs its own row alone. A batch is worked off in slices of texts whose draws fit in memory.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, table

SAMPLES, SEED = 64, 8
#: Terms whose draws are held at a time
MAX_DRAWN = 50_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit counter generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(terms: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term (a 64-bit hash) and sample, float32 arrays of (terms, samples)."""
    lane = np.arange(samples * 5, dtype=np.uint64).reshape(5, 1, samples) * np.uint64(0x9E3779B97F4A7C15)
    out = [np.empty((len(terms), samples), np.float32) for _ in range(3)]
    for i in range(0, len(terms), 2048):
        u = (_mixed(terms[i : i + 2048, None] + lane) >> np.uint64(40)).astype(np.float32)
        u = (u + np.float32(0.5)) * np.float32(2**-24)
        out[0][i : i + 2048] = -np.log(u[0] * u[1])
        out[1][i : i + 2048] = np.log(-np.log(u[2] * u[3]))
        out[2][i : i + 2048] = u[4]
    return out[0], out[1], out[2]


class Sampler:
    """Signatures of weighted terms; the draws of frequent terms are kept."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.place, self.held = samples, {}, 0
        self.hash = np.empty(MAX_DRAWN, np.uint64)
        self.r, self.c, self.b = (np.empty((MAX_DRAWN, samples), np.float32) for _ in range(3))

    def _places(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.place]
        if self.held + len(new) > MAX_DRAWN:
            self.place.clear()
            self.held, new = 0, words
        if new:
            at = slice(self.held, self.held + len(new))
            self.hash[at] = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), np.uint64, len(new))
            self.r[at], self.c[at], self.b[at] = draws(self.hash[at], self.samples)
            self.place.update(zip(new, range(at.start, at.stop), strict=True))
            self.held = at.stop
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def __call__(self, text: str) -> np.ndarray:
        """The signature: a 64-bit hash of (term, t) for each sample; zeros for a text without words."""
        counts = Counter(text.encode().split())  # bytes are split at exactly U+0009 to U+000D and the space
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        words = list(counts)
        for i in range(0, len(words), 4096):  # the minimum over slices is the minimum over all
            at = self._places(words[i : i + 4096])
            weight = np.fromiter((counts[w] for w in words[i : i + 4096]), np.float32, len(at))
            r, b = self.r[at], self.b[at]
            t = np.floor(np.log(weight)[:, None] / r + b)
            a = self.c[at] - r * (t - b + 1)
            least = a.argmin(axis=0)
            lane = np.arange(self.samples)
            value = a[least, lane]
            # float32 draws tie too rarely to matter; the first of a tie is the word that stands first
            term = self.hash[at][least]
            take = value < best
            out[take] = _mixed(term + t[least, lane].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[take]
            best[take] = value[take]
        return out


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal samples."""
    return float(np.mean(a == b))


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u8").tobytes().hex()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, samples: int = SAMPLES) -> DataFrame:
    """(doc_id, fingerprint): the signature of each row's text, 16 hexadecimal digits a sample.

    Null texts count as empty; texts without words have a signature of zeros. Rows with null or repeated ids are taken
    one by one and equal texts have equal fingerprints. An empty table gives an empty result; other columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for b in batches:
            found = pa.array([hexed(sampler(x.as_py())) for x in b.column("_text")], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), found], names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def with_successor(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, parts: int | None = None) -> DataFrame:
    """(doc_id, text, last) dealt by ranges of ids and sorted: a row's successor follows it in its partition.

    Rows marked `last` are not the partition's own: the first row of the next range, or for the last range of the first.
    Ids are whole numbers; null ids stand first, and rows of one id are ordered by a hash of their text.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    keys = kept(rows.select("doc_id", "h"))
    cuts = sorted(set(keys.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    inner = F.array(*(F.lit(int(c)) for c in cuts)) if cuts else None
    place = (F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(inner, lambda c: c <= F.col("doc_id")))) if cuts else F.lit(0)).cast("int")
    # one row a range: bounded by the number of partitions
    firsts = keys.withColumn("part", place).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("f")).orderBy("part").collect()
    if not firsts:
        return rows.select("doc_id", "text", F.lit(False).alias("last"))
    used = [f["part"] for f in firsts]
    table_of = {(f["f"]["doc_id"], f["f"]["h"]): used[i - 1] for i, f in enumerate(firsts)}
    bounds = df.sparkSession.createDataFrame([(i, h, p) for (i, h), p in table_of.items()], "bi long, bh long, bp int")
    own = F.struct(F.col("part"), F.lit(False).alias("last"))
    rows = rows.withColumn("part", place)
    rows = rows.join(F.broadcast(bounds), rows["doc_id"].eqNullSafe(bounds["bi"]) & (rows["h"] == bounds["bh"]), "left")
    also = F.when(F.col("bp").isNotNull(), F.struct(F.col("bp").alias("part"), F.lit(True).alias("last")))
    rows = rows.select("doc_id", "text", "h", F.explode(F.array_compact(F.array(own, also))).alias("x")).select("doc_id", "text", "h", "x.*")
    dealt = rows.repartitionById(max(used) + 1, F.col("part")).sortWithinPartitions("part", "last", "doc_id", "h")
    return dealt.select("doc_id", "text", "last")


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    dealt = with_successor(table(spark, folder, "documents"))
    names = [x.split()[0] for x in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        held: tuple | None = None
        for b in batches:
            out = []
            for doc_id, text, last in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "last")), strict=True):
                own = sampler(text)
                if held:
                    i, t, f = held
                    e = edited(t, text)
                    g = sampler(e)
                    out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexed(f), hexed(g), alike(f, g), alike(f, own)))
                held = None if last else (doc_id, text, own)
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return dealt.mapInArrow(run, _FIELDS)


QUERIES = {"op8_fingerprints": op8_fingerprints}
