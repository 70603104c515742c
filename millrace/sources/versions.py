"""A versioned table: immutable Parquet chunks, one manifest for each version, copy-on-write by (chunk, row).

A version lists the chunks that it adds, with their rows and the least and greatest value of each column, and those
that it retires. Version v is what the first v manifests leave; a version beyond the last is the last, version 0 is
empty. A chunk's rows are numbered from 0.

Scale: a commit writes all chunks that it touches in one job and takes their statistics in one aggregate. Manifests
hold a line for each chunk, so the driver reads what grows with the number of files, not with rows. A read prunes
chunks by the stored statistics before the scan is planned, and Parquet pushdown goes on inside them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.relational import in_ranges
from ..workspace import file_system

ROW, CHUNK = "_row", "_chunk"


@dataclass(frozen=True)
class MinMax:
    """The least and the greatest value of a column; None where it has none."""

    least: object
    greatest: object

    def __post_init__(self) -> None:
        if self.least is not None and self.least > self.greatest:
            raise ValueError("the least value is above the greatest")

    def contains(self, value: object) -> bool:
        return self.least is not None and self.least <= value <= self.greatest

    def overlaps(self, lo: object, hi: object) -> bool:
        return self.least is not None and lo <= hi and self.least <= hi and lo <= self.greatest


@dataclass
class Manifest:
    """What one version adds, {chunk: (rows, {column: MinMax})}, and retires."""

    added: dict[str, tuple[int, dict[str, MinMax]]] = field(default_factory=dict)
    deleted: list[str] = field(default_factory=list)

    def dumps(self) -> str:
        added = [{"chunk": c, "rows": n, "stats": {k: [m.least, m.greatest] for k, m in s.items()}} for c, (n, s) in self.added.items()]
        return json.dumps({"added": added, "deleted": self.deleted})

    @classmethod
    def loads(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls({a["chunk"]: (a["rows"], {k: MinMax(*m) for k, m in a["stats"].items()}) for a in found["added"]}, found["deleted"])


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.open: Modification | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType) -> VersionedTable:
        table = cls(spark, path)
        table._put("schema.json", schema.json())
        return table

    def _put(self, name: str, text: str) -> None:
        """Writes a file that must not exist yet, which is what makes a commit atomic."""
        files, where = file_system(self.spark, f"{self.path}/{name}")
        out = files.create(where, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _get(self, name: str) -> str:
        files, where = file_system(self.spark, f"{self.path}/{name}")
        size = files.getFileStatus(where).getLen()
        read = files.open(where)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(read, size)).decode()
        finally:
            read.close()

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self._get("schema.json")))

    @property
    def latest(self) -> int:
        files, where = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in files.listStatus(where)]
        return max((int(n[:-5]) for n in names if n[:-5].isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> list[Manifest]:
        """The first `version` manifests; all for None or a version beyond the last."""
        last = self.latest
        return [Manifest.loads(self._get(f"{v:08d}.json")) for v in range(1, (last if version is None else min(version, last)) + 1)]

    def chunks(self, version: int | None = None) -> dict[str, tuple[int, dict[str, MinMax]]]:
        """The chunks of a version with their rows and statistics."""
        live: dict = {}
        for m in self.snapshot(version):
            live.update(m.added)
            for c in m.deleted:
                del live[c]
        return live

    def contains(self, equal: dict[str, object], version: int | None = None) -> list[str]:
        """Chunks whose statistics allow all these values."""
        return [c for c, (_, s) in self.chunks(version).items() if all(s[k].contains(v) for k, v in equal.items())]

    def contains_range(self, ranges: dict[str, tuple], version: int | None = None) -> list[str]:
        """Chunks whose statistics overlap all these inclusive ranges."""
        return [c for c, (_, s) in self.chunks(version).items() if all(s[k].overlaps(*r) for k, r in ranges.items())]

    def rows(self, chunks: Iterable[str]) -> DataFrame:
        """The rows of chunks with `_chunk` and `_row`."""
        inner = StructType.fromJson(self.schema.jsonValue()).add(ROW, "long")
        paths = [f"{self.path}/data/{c}" for c in chunks]
        if not paths:
            return self.spark.createDataFrame([], inner).withColumn(CHUNK, F.lit(""))
        return self.spark.read.schema(inner).parquet(*paths).withColumn(CHUNK, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))

    def read(self, version: int | None = None, ranges: dict[str, tuple] | None = None) -> DataFrame:
        """The rows of a version that lie in all the inclusive ranges; only chunks that may hold some are read."""
        found = self.contains_range(ranges, version) if ranges else list(self.chunks(version))
        return in_ranges(self.rows(found).drop(CHUNK, ROW), ranges or {})

    def modify(self) -> Modification:
        if self.open is not None:
            raise RuntimeError("a modification of this table is open")
        self._get("schema.json")  # an unknown table fails here
        self.open = Modification(self)
        return self.open


class Modification:
    """Changes that commit() makes one new version."""

    def __init__(self, table: VersionedTable):
        self.table, self.base, self.live, self.manifest = table, table.latest, table.chunks(), Manifest()
        self.touched: set[str] = set()

    def _check(self, chunks: list[str]) -> None:
        if self.table.open is not self:
            raise RuntimeError("the modification is closed")
        if len(set(chunks)) < len(chunks):
            raise ValueError("a chunk is named twice")
        for c in chunks:
            if c not in self.live or c in self.touched:
                raise ValueError(f"chunk {c} is unknown, retired or already changed here")

    def _write(self, rows: DataFrame, group: Column, order: list[Column]) -> dict[object, str]:
        """Writes a chunk for each group of rows, numbered in this order; the new chunks by group."""
        table, names = self.table, [f.name for f in self.table.schema]
        stage = f"{table.path}/data/{uuid.uuid4().hex}"
        numbered = rows.withColumn("_group", group)
        numbered = numbered.withColumn(ROW, (F.row_number().over(Window.partitionBy("_group").orderBy(*order)) - 1).cast("long"))
        # the window has dealt a chunk's rows to one task, so each chunk becomes one file
        numbered.select(*names, ROW, "_group").write.partitionBy("_group").parquet(stage)
        written = table.spark.read.parquet(stage)
        stats = written.groupBy("_group").agg(F.count("*").alias("_n"), *(f(c).alias(f"{n}_{i}") for i, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max)))).collect()
        files, _ = file_system(table.spark, table.path)
        path = table.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        out = {}
        for r in stats:  # one row a chunk
            chunk = uuid.uuid4().hex
            files.rename(path(f"{stage}/_group={r['_group']}"), path(f"{table.path}/data/{chunk}"))
            self.manifest.added[chunk] = r["_n"], {c: MinMax(r[f"lo_{i}"], r[f"hi_{i}"]) for i, c in enumerate(names)}
            self.touched.add(chunk)
            out[r["_group"]] = chunk
        files.delete(path(stage), True)
        return out

    def insert(self, rows: DataFrame, chunk: Column, *order: Column) -> dict[object, str]:
        """Adds a chunk for each value of the whole number `chunk`; its rows are numbered by `order`."""
        self._check([])
        return self._write(rows, chunk.cast("long"), list(order) or [F.lit(0)])

    def update(self, changes: DataFrame) -> None:
        """changes: (_chunk, _row, columns to overwrite); a row is named once. All is checked before anything is written."""
        named = [r[0] for r in changes.select(CHUNK).distinct().collect()]  # one row a chunk
        self._check(named)
        sizes = self.table.spark.createDataFrame([(c, self.live[c][0]) for c in named], f"{CHUNK} string, _n long")
        wrong = changes.join(F.broadcast(sizes), CHUNK).where((F.col(ROW) < 0) | (F.col(ROW) >= F.col("_n")))
        if not wrong.isEmpty():
            raise IndexError("a row beyond its chunk")
        new = [c for c in changes.columns if c not in (CHUNK, ROW)]
        changed = changes.select(F.col(CHUNK).alias("_c"), F.col(ROW).alias("_r"), F.struct(*new).alias("_new"))
        rows = self.table.rows(named).join(changed, (F.col(CHUNK) == F.col("_c")) & (F.col(ROW) == F.col("_r")), "left")
        # a change to null is a change too, so what counts is that there is one
        rows = rows.withColumns({c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)) for c in new})
        self._write(rows, F.col(CHUNK), [F.col(ROW)])
        self._retire(named)

    def delete(self, rows: DataFrame) -> None:
        """rows: (_chunk, _row). Rows beyond their chunk are ignored; a chunk without rows left is only retired."""
        named = [r[0] for r in rows.select(CHUNK).distinct().collect()]
        self._check(named)
        self._write(self.table.rows(named).join(rows.select(CHUNK, ROW), [CHUNK, ROW], "left_anti"), F.col(CHUNK), [F.col(ROW)])
        self._retire(named)

    def delete_chunks(self, chunks: list[str]) -> None:
        self._check(chunks)
        self._retire(chunks)

    def _retire(self, chunks: list[str]) -> None:
        self.touched.update(chunks)
        self.manifest.deleted.extend(chunks)

    def abort(self) -> None:
        """Ends the modification without a version; chunks written so far are removed."""
        self._check([])
        self.table.open = None
        for c in self.manifest.added:
            files, where = file_system(self.table.spark, f"{self.table.path}/data/{c}")
            files.delete(where, True)

    def commit(self) -> int:
        """Ends the modification; a new version if anything has changed. Another writer's commit in between makes it fail."""
        self._check([])
        self.table.open = None
        if self.manifest.added or self.manifest.deleted:
            self.table._put(f"{self.base + 1:08d}.json", self.manifest.dumps())
        return self.table.latest
