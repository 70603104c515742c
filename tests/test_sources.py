"""The versioned table against a plain model, and the columnar format's bytes."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.sources import columnar
from millrace.sources.versions import CHUNK, ROW, MinMax, VersionedTable


@pytest.fixture()
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i}", i * 1.5) for i in range(30)], "id long, name string, v double")
    table = VersionedTable.create(spark, f"file://{tmp_path}/t", df.schema)
    change = table.modify()
    change.insert(df, F.expr("id div 10"), F.col("id"))
    change.commit()
    return table


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_versions_and_clamping(spark, table):
    assert table.latest == 1 and table.read(0).count() == 0 and table.chunks(0) == {}
    change = table.modify()
    change.delete(table.rows(table.chunks()).where("id % 2 = 0 OR id >= 20").select(CHUNK, ROW))
    assert change.commit() == 2
    assert ids(table.read(1)) == list(range(30)) and ids(table.read(2)) == ids(table.read(99)) == ids(table.read()) == list(range(1, 20, 2))
    assert len(table.chunks(1)) == 3 and len(table.chunks(2)) == 2  # all rows of the third are gone
    assert sorted(r[ROW] for r in table.rows(table.chunks()).collect()) == sorted([*range(5)] * 2)


def test_updates(spark, table):
    rows = table.rows(table.chunks())
    change = table.modify()
    change.update(rows.where("id IN (3, 14)").select(CHUNK, ROW, F.when(F.col("id") == 3, F.lit("new")).alias("name")))
    change.commit()
    found = {r["id"]: (r["name"], r["v"]) for r in table.read().collect()}
    assert found[3] == ("new", 4.5) and found[14] == (None, 21.0) and found[4] == ("n4", 6.0) and len(found) == 30
    with pytest.raises(IndexError):
        change = table.modify()
        change.update(spark.createDataFrame([(c, 10, "x") for c in table.chunks()], f"{CHUNK} string, {ROW} long, name string"))
    change.abort()
    assert table.latest == 2


def test_what_a_modification_refuses(spark, table):
    old = list(table.chunks())
    change = table.modify()
    with pytest.raises(RuntimeError):
        table.modify()
    with pytest.raises(ValueError):
        change.delete_chunks(["unknown"])
    with pytest.raises(ValueError):
        change.delete_chunks([old[0], old[0]])
    change.delete_chunks([old[0]])
    with pytest.raises(ValueError):
        change.delete(table.rows([old[0]]).select(CHUNK, ROW))  # touched here already
    change.commit()
    with pytest.raises(RuntimeError):
        change.commit()
    with pytest.raises(ValueError):
        table.modify().delete_chunks([old[0]])  # retired
    table.open.abort()
    assert table.modify().commit() == 2  # nothing has changed
    with pytest.raises(Exception, match="schema.json"):
        VersionedTable(spark, table.path + "-unknown").modify()


def test_a_commit_in_between_fails(spark, table):
    a, b = table.modify(), VersionedTable(spark, table.path).modify()
    for change in (a, b):
        change.delete_chunks([list(change.live)[0]])
    a.commit()
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        b.commit()


def test_deletes_beyond_a_chunk_are_ignored(spark, table):
    change = table.modify()
    change.delete(spark.createDataFrame([(c, 77) for c in table.chunks()], f"{CHUNK} string, {ROW} long"))
    change.commit()
    assert table.read().count() == 30


def test_statistics_skip_chunks_in_the_plan(spark, table):
    assert len(table.contains({"id": 15})) == 1 and table.contains({"id": 31}) == [] and len(table.contains({"id": 15}, version=0)) == 0
    assert len(table.contains_range({"id": (5, 12)})) == 2 and table.contains_range({"id": (12, 5)}) == []
    df = table.read(ranges={"id": (12, 14), "v": (0.0, 20.0)})
    assert ids(df) == [12, 13] and len(df.inputFiles()) == 1
    assert "PushedFilters: [IsNotNull(id)" in df._jdf.queryExecution().executedPlan().toString()


def test_min_max():
    with pytest.raises(ValueError):
        MinMax(2, 1)
    m = MinMax(2, 5)
    assert m.contains(2) and m.contains(5) and not m.contains(6)
    assert m.overlaps(5, 9) and m.overlaps(0, 2) and m.overlaps(3, 4) and not m.overlaps(6, 9) and not m.overlaps(4, 3)
    assert not MinMax(None, None).contains(1) and not MinMax(None, None).overlaps(0, 9)


def test_columnar_bytes():
    data = columnar.encoded([[1, -2, 3], [4, 5, 2**32 - 1]], [columnar.INT, columnar.UINT])
    assert len(data) == 80 and data[:8] == columnar.MAGIC
    assert columnar.header(data) == (3, [(columnar.INT, 56), (columnar.UINT, 68)])
    assert columnar.decoded(data) == [[1, -2, 3], [4, 5, 2**32 - 1]] and columnar.decoded(data, [1]) == [[4, 5, 2**32 - 1]]
    with pytest.raises(ValueError):
        columnar.header(b"x" * 80)
    with pytest.raises(ValueError):
        columnar.encoded([[2**32]], [columnar.UINT])
    with pytest.raises(ValueError):
        columnar.inferred([[1], []])
    assert columnar.inferred([[1], ["a"]]) == [columnar.INT, columnar.VARCHAR]


def test_columnar_files(spark, tmp_path):
    random.seed(3)
    columns = {"a": columnar.INT, "s": columnar.VARCHAR, "r": columnar.ROW_ID}
    rows = [(random.randint(-9, 9), random.choice(["", "é😀", "x" * 5000]), random.randrange(2**63)) for _ in range(300)]
    for i in range(3):
        part = rows[i * 100 : (i + 1) * 100]
        columnar.write(spark, f"file://{tmp_path}/c/{i}.bin", [list(c) for c in zip(*part)], list(columns.values()))
    assert sorted(tuple(r) for r in columnar.read(spark, f"file://{tmp_path}/c", columns).collect()) == sorted(rows)
    assert columnar.read(spark, f"file://{tmp_path}/c", columns, ["r", "a"]).columns == ["r", "a"]
