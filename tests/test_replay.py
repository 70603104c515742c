"""Replays of page buffers and locks against rules written out by hand."""

import random

import pytest

from millrace.replay import buffer, locks


def test_lru_by_reuse_distance(spark):
    random.seed(2)
    pages = [random.randrange(9) for _ in range(400)]
    for capacity in (1, 3, 9):
        pool = buffer.Pool(capacity)
        for i, p in enumerate(pages):
            hit, _, _ = pool.pin(p)
            pool.unpin(p)
            before = max((j for j in range(i) if pages[j] == p), default=None)
            assert hit == (before is not None and len(set(pages[before + 1 : i])) < capacity)
    rows = spark.createDataFrame([(t, i, p) for t in "ab" for i, p in enumerate(pages)], "trace string, seq long, page long")
    found = buffer.replayed(rows, "trace", "seq", "page", 3, "clock").orderBy("trace", "seq").collect()
    assert [r["hit"] for r in found[:400]] == [r["hit"] for r in found[400:]] and any(r["evicted"] is not None for r in found)


@pytest.mark.parametrize("strategy", ["lru", "clock"])
def test_pinned_pages_stay(strategy):
    pool = buffer.Pool(2, strategy)
    pool.pin(1)
    pool.pin(2)
    with pytest.raises(buffer.AllPagesPinned):
        pool.pin(3)
    pool.unpin(2, dirty=True)
    assert pool.pin(3) == (False, 2, True)
    with pytest.raises(KeyError):
        pool.unpin(2)
    assert pool.pin(1) == (True, None, False)


def test_clock_gives_a_second_chance():
    pool = buffer.Pool(3, "clock")
    for p in (1, 2, 3):
        pool.pin(p)
        pool.unpin(p)
    assert pool.pin(4)[1] == 1  # all bits are cleared once round, then the first goes
    pool.unpin(4)
    pool.pin(2)  # its bit is set again
    pool.unpin(2)
    assert pool.pin(5)[1] == 3


def test_a_dirty_page_stays_dirty_unless_overwritten():
    for overwrite, wrote in ((False, True), (True, False)):
        pool = buffer.Pool(1, overwrite=overwrite)
        pool.pin(1)
        pool.pin(1)
        pool.unpin(1, dirty=True)
        pool.unpin(1, dirty=False)
        assert pool.pin(2) == (False, 1, wrote)


def test_page_file():
    file = buffer.PageFile()
    assert [file.allocate() for _ in range(3)] == [1, 2, 3]
    file.write(2, b"x")
    file.free(2)
    file.free(1)
    for wrong in (0, 1, 9):
        with pytest.raises(KeyError):
            file.free(wrong)
    assert [file.allocate() for _ in range(3)] == [2, 1, 4] and file.read(2) == b""


def test_lock_table():
    t = locks.LockTable()
    assert t.lock(1, "o", locks.READ) == "granted" and t.lock(1, "o", locks.READ) == "held"
    assert t.lock(1, "o", locks.WRITE) == "granted"  # the sole reader becomes the writer
    assert t.lock(1, "o", locks.READ) == "held" and t.lock(2, "o", locks.READ) == "queued" and t.lock(3, "o", locks.WRITE) == "queued" and t.lock(4, "o", locks.READ) == "queued"
    assert t.release(1, "o") == [2]  # the writer behind it can't be granted, so the line stops there
    assert t.lock(5, "o", locks.READ) == "granted"  # a reader passes the waiting writer
    assert t.release(2, "o") == [] and t.release(5, "o") == [3] and t.release(3, "o") == [4]
    assert t.state("o") == ({4: locks.READ}, []) and t.release(9, "unknown") == []


def test_lock_tree():
    t = locks.LockTree()
    assert t.lock(1, ("db", "a", "x"), "S") and t.lock(2, ("db", "a", "y"), "X")
    assert not t.lock(3, ("db", "a"), "S")  # denied at the leaf by an intention to write
    assert not t.lock(3, ("db", "a", "y", "z"), "S")  # denied at an ancestor
    assert t.lock(3, ("db", "b"), "X") and t.lock(3, ("log",), "S")
    assert not t.lock(3, ("db", "a", "x"), "X")  # a denial takes back all that it holds, under both roots
    assert t.state(("db", "b")) == t.state(("log",)) == []
    t.release(2)
    assert t.lock(3, ("db", "a"), "S") and t.state(("db", "a")) == [(1, "IS"), (3, "S")]
    assert not t.lock(1, ("db", "a", "y"), "X")


def test_replays_run_in_order_whatever_the_rows_order(spark):
    random.seed(4)
    rows = [(random.choice("xy"), i, random.randrange(4), random.choice([locks.READ, locks.WRITE, "release"])) for i in range(200)]
    schema = "obj string, seq long, t long, action string"
    first = sorted(tuple(r) for r in locks.replayed(spark.createDataFrame(rows, schema), "obj", "seq", "t", "action").collect())
    random.shuffle(rows)
    assert first == sorted(tuple(r) for r in locks.replayed(spark.createDataFrame(rows, schema).repartition(7), "obj", "seq", "t", "action").collect())
    model = locks.LockTable()
    for obj, seq, t, action, outcome in sorted(first, key=lambda r: r[1]):
        assert outcome == (",".join(map(str, model.release(t, obj))) if action == "release" else model.lock(t, obj, action))
