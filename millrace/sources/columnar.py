"""The columnar chunk format: a header, then each column's values, little-endian.

Header: 8 magic bytes, the numbers of rows and columns, and for each column its type and where it starts. A varchar is
its length in bytes and its UTF-8. Files are read by Spark's binary file source, so any store will do, and only the
wanted columns are decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..workspace import file_system

#: fixed values of the format
MAGIC = bytes.fromhex("53444d5319034a53")
INT, UINT, ROW_ID, VARCHAR = 0, 1, 2, 3
_NUMPY = {INT: "<i4", UINT: "<u4", ROW_ID: "<u8"}
_SQL = {INT: "int", UINT: "bigint", ROW_ID: "bigint", VARCHAR: "string"}
_ARROW = {INT: pa.int32(), UINT: pa.int64(), ROW_ID: pa.int64(), VARCHAR: pa.string()}


def inferred(columns: list[list]) -> list[int]:
    """The type of each column by its first value; an empty column has none."""
    if any(not c for c in columns):
        raise ValueError("an empty column has no type")
    return [VARCHAR if isinstance(c[0], str) else INT for c in columns]


def encoded(columns: list[list], types: list[int] | None = None) -> bytes:
    types = inferred(columns) if types is None else types
    rows = len(columns[0]) if columns else 0
    if any(len(c) != rows for c in columns):
        raise ValueError("columns of different lengths")
    parts = []
    for c, t in zip(columns, types, strict=True):
        if t == VARCHAR:
            parts.append(b"".join(struct.pack("<Q", len(b)) + b for b in (x.encode() for x in c)))
        else:
            kind = np.iinfo(_NUMPY[t])
            if any(not kind.min <= x <= kind.max for x in c):
                raise ValueError("a value beyond its type")
            parts.append(np.array(c, dtype=_NUMPY[t]).tobytes())
    at, head = 24 + 16 * len(columns), [MAGIC, struct.pack("<QQ", rows, len(columns))]
    for t, part in zip(types, parts, strict=True):
        head.append(struct.pack("<QQ", t, at))
        at += len(part)
    return b"".join(head + parts)


def header(data: bytes) -> tuple[int, list[tuple[int, int]]]:
    """The number of rows, and (type, start) of each column."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of this format")
    rows, n = struct.unpack_from("<QQ", data, 8)
    return rows, [struct.unpack_from("<QQ", data, 24 + 16 * i) for i in range(n)]


def decoded(data: bytes, wanted: list[int] | None = None) -> list[list]:
    """The wanted columns, or all."""
    rows, columns = header(data)
    out = []
    for i in range(len(columns)) if wanted is None else wanted:
        kind, at = columns[i]
        if kind == VARCHAR:
            values = []
            for _ in range(rows):
                (size,) = struct.unpack_from("<Q", data, at)
                values.append(data[at + 8 : at + 8 + size].decode())
                at += 8 + size
            out.append(values)
        else:
            out.append(np.frombuffer(data, dtype=_NUMPY[kind], count=rows, offset=at).tolist())
    return out


def read(spark: SparkSession, path: str, columns: dict[str, int], wanted: list[str] | None = None) -> DataFrame:
    """The rows of all files at a path. columns: {name: type} in the order of the files; row ids from 2^63 on fail."""
    names = list(columns)
    wanted = names if wanted is None else wanted
    at = [names.index(w) for w in wanted]
    kinds = [columns[w] for w in wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                values = decoded(data.as_py(), at)
                yield pa.RecordBatch.from_arrays([pa.array(v, _ARROW[k]) for v, k in zip(values, kinds, strict=True)], names=wanted)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"`{w}` {_SQL[k]}" for w, k in zip(wanted, kinds, strict=True)))


def write(spark: SparkSession, path: str, columns: list[list], types: list[int] | None = None) -> None:
    """One chunk as one file, through the store's own client; a table is written chunk by chunk."""
    files, where = file_system(spark, path)
    out = files.create(where, False)
    try:
        out.write(bytearray(encoded(columns, types)))
    finally:
        out.close()
