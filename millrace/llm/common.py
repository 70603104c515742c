"""What several training-data operators share: durable tables, key joins and regex spans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are neither a space nor one of U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _own_folder.get(app) or _own_folder.setdefault(app, "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return found.rstrip("/")


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def kept(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: lineage ends there, so a lost executor costs no recomputation.

    The files go with dropped(), else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/millrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _at(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of kept() tables that nothing will read again."""
    for df in tables:
        files, where = _at(df.sparkSession, df._kept_at)
        files.delete(where, True)


def sized(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= max_rows else df


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that name a row even if ids repeat or are null: rows with equal keys are equal rows."""
    return [doc_id.alias("_id"), F.xxhash64(text).alias("_h")]


def on_row(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: a later filter or column doesn't get their long expressions substituted."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


#: Elements of an array that are folded at a time: an array of n takes about n * BLOCK / 2 steps, not n * n / 2
BLOCK = 256


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def folded(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column | None]]) -> Column:
    """array<kind> of what a fold over items emits. step(at, item): the next at (an int, 0 at first), the value, and whether to emit it (None: always)."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        at, value, emits = step(acc["at"], x)
        grown = F.concat(acc["out"], F.array(value.cast(kind)))
        return F.struct(at.cast("int").alias("at"), (grown if emits is None else F.when(emits, grown).otherwise(acc["out"])).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return F.get(F.transform(F.array(inner), lambda z: F.struct(z["at"].alias("at"), F.concat(acc["out"], F.array(z["out"])).alias("out"))), F.lit(0))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(_blocks(items), start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


SPAN = "struct<start:int,end:int,value:string>"


def found_spans(values: Column, gaps: Column, good: Callable[[Column], Column] | None = None) -> Column:
    """Spans of a regex's matches as array<struct<start, end, value>>, in code points with the end exclusive.

    values: regexp_extract_all(text, regex, 0). gaps: split(text, regex, -1), the texts between those matches.
    Both run the same matcher, so gap i stands right before value i. good: which values to return, all without it.
    """
    def step(at: Column, x: Column) -> tuple[Column, Column, Column | None]:
        start = at + F.length(x["g"])
        end = start + F.length(x["v"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value")), good(x["v"]) if good else None

    return folded(F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("g"), values.alias("v")), SPAN, step)


def united(spans: Column) -> Column:
    """array<struct<start, end, new>>: spans (start, end, new) in order, those that overlap as one with the first's `new`."""
    def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["end"]), F.struct(s["start"].alias("start"), at.alias("before"), s["new"].alias("new")), s["start"] >= at

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    firsts = folded(spans, "struct<start:int,before:int,new:string>", step)
    ends = lambda all_: F.transform(all_, lambda s, i: F.struct(s["start"].alias("start"), F.coalesce(F.get(all_, i + 1)["before"], last).alias("end"), s["new"].alias("new")))
    return F.get(F.transform(F.array(firsts), ends), F.lit(0))


def replaced(text: Column, spans: Column) -> Column:
    """text with `new` in place of each of its united() spans. A block of spans is worked off in its own part of the text."""
    def part(b: Column) -> Column:
        begin = F.get(spans, b * BLOCK)["start"]
        end = F.coalesce(F.get(spans, (b + 1) * BLOCK)["start"], F.length(text))

        def pieces(own: Column) -> Column:
            after = lambda s, i: F.coalesce(F.get(spans, b * BLOCK + i + 1)["start"], F.length(text))
            return F.array_join(F.transform(F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)), lambda s, i: F.concat(s["new"], F.substring(own, s["end"] - begin + 1, after(s, i) - s["end"]))), "")

        return F.get(F.transform(F.array(F.substring(text, begin + 1, end - begin)), pieces), F.lit(0))

    numbers = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    whole = F.concat(F.substring(text, F.lit(1), F.get(spans, F.lit(0))["start"]), F.array_join(F.transform(numbers, part), ""))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def spans_of(df: DataFrame, text: str, regexes: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """df with a column of spans for each entry name: (Java regex, condition under which to search at all)."""
    values = {n: F.regexp_extract_all(F.col(text), F.lit(r), F.lit(0)) for n, (r, _) in regexes.items()}
    none = F.array().cast("array<string>")
    df = df.withColumns({f"_v_{n}": F.when(cond, values[n]).otherwise(none) if cond is not None else values[n] for n, (_, cond) in regexes.items()})
    df = df.withColumns({f"_g_{n}": F.when(F.size(f"_v_{n}") > 0, F.split(F.col(text), r, -1)) for n, (r, _) in regexes.items()})
    df = once(df, **{n: found_spans(F.col(f"_v_{n}"), F.col(f"_g_{n}")) for n in regexes})
    return df.drop(*(f"_{k}_{n}" for n in regexes for k in "vg"))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
