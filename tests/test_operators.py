"""Edge cases of the operators, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import bitmap, exchange, joins, keyed, kway
from millrace.operators import relational as rel
from millrace.plans import workload


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def sides(spark):
    random.seed(1)
    left = [(random.choice([-1, -7, 0, 3, 5, 2**62]), i) for i in range(40)]
    right = [(random.choice([-1, -7, 1, 3, 5, 2**62]), i) for i in range(60)]
    return left, right, spark.createDataFrame(left, "k long, a long"), spark.createDataFrame(right, "q long, b long")


def test_joins_with_duplicate_and_negative_keys(sides):
    left, right, dl, dr = sides
    every = sorted((a, b) for k, a in left for q, b in right if k == q)
    first = {}
    for k, a in left:
        first.setdefault(k, a)
    last = dict(left)
    assert pairs(joins.symmetric_join(dl, dr, "k", "q", 4).select("a", "b")) == every
    assert pairs(joins.asymmetric_join(exchange.dealt(dl, "k", 4), dr, "k", "q").select("a", "b")) == every
    assert pairs(rel.replication_join(dl, dr, "k", "q").select("a", "b")) == every
    assert pairs(rel.hash_join(dl, dr, "k", "q").select("a", "b")) == every
    for found in (joins.radix_join(dl, dr, "k", "q", seq="a"), joins.radix_join(dl, dr, "k", "q", seq="a", bits=3), rel.hash_join(dl, dr, "k", "q", duplicates="first", seq="a")):
        assert pairs(found.select("a", "b")) == sorted((first[q], b) for q, b in right if q in first)
    assert pairs(rel.hash_join(dl, dr, "k", "q", duplicates="last", seq="a").select("a", "b")) == sorted((last[q], b) for q, b in right if q in last)


@pytest.mark.parametrize("empty", ["left", "right"])
def test_joins_with_an_empty_side(sides, empty):
    _, _, dl, dr = sides
    dl, dr = (dl.limit(0), dr) if empty == "left" else (dl, dr.limit(0))
    for found in (joins.symmetric_join(dl, dr, "k", "q", 4), joins.radix_join(dl, dr, "k", "q"), rel.replication_join(dl, dr, "k", "q"), rel.hash_join(dl, dr, "k", "q", duplicates="last", seq="a")):
        assert found.count() == 0


@pytest.mark.parametrize(("rows", "sent"), [(1_000, True), (1_000_000, False)])
def test_replication_join_sends_only_what_fits_in_memory(spark, tmp_path, rows, sent):
    # a file of a few KB whatever the rows
    spark.range(rows).select((F.col("id") % 3).alias("q"), F.lit(7).alias("b")).write.parquet(f"{tmp_path}/right")
    right, left = spark.read.parquet(f"{tmp_path}/right"), spark.createDataFrame([(1, 4), (5, 6)], "k long, a long")
    assert rel.estimated_bytes(right) < 1 << 20
    found = rel.replication_join(left, right, "k", "q")
    assert found.count() == len(range(1, rows, 3))
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == sent


def test_held_bytes_counts_texts_and_no_rows(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, None)], "k long, t string")
    assert rel.held_bytes(df) == 2 * (rel.ROW_BYTES + 16) + 1000
    assert rel.held_bytes(df.limit(0)) == 0


def test_asymmetric_join_moves_only_the_right_side(spark, sides):
    _, _, dl, dr = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joins.asymmetric_join(exchange.dealt(dl, "k", 4), dr, "k", "q")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2  # the dealing itself, and the right side
        plan = joins.symmetric_join(dl, dr, "k", "q", 4)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_unsigned_keys_and_slots(spark):
    keys = [0, 1, 17, 2**62, -1, -2, -(2**63)]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", exchange.node_of(F.col("k"), 6, 4).alias("node"), exchange.slot(F.col("k"), 1 << 10).alias("slot"))
    for k, node, slot in rows.collect():
        u = k % 2**64
        assert node == u % 6 % 4 and slot == (u * 0x9E3779B97F4A7C15 % 2**64 >> 32) & 1023


@pytest.mark.parametrize("lo, hi", [(3, 9), (40, 50), (40, 80), (60, 70), (9, 3), (-5, 0), (50, 50), (0, 49), (7, 1000)])
def test_bitmap_ranges(spark, lo, hi):
    random.seed(5)
    # row ids over several words, with bit 63 and beyond what a double holds
    ids = [0, 1, 62, 63, 64, 127, 128, 2**53 + 1, 2**53 + 2, 2**60 + 63]
    rows = [(i, random.choice([0, 3, 7, 9, 12, 40, 49, 50])) for i in ids]
    df = spark.createDataFrame(rows, "id long, v int")
    want = sorted((i,) for i, v in rows if lo <= v <= hi)
    assert pairs(bitmap.row_ids(bitmap.lookup(bitmap.naive(df, "v", "id"), lo, hi))) == want
    assert pairs(bitmap.row_ids(bitmap.range_encoded_lookup(bitmap.range_encoded(df, "v", "id"), lo, hi))) == want
    for base in (2, 5, 51):
        assert pairs(bitmap.row_ids(bitmap.decomposed_lookup(bitmap.decomposed(df, "v", "id", base, 50), lo, hi, base, 50))) == want


def test_bitmap_algebra_and_digits(spark):
    a, b = spark.createDataFrame([(0, 0b1101), (2, -(2**63))], "word long, bits long"), spark.createDataFrame([(0, 0b0111), (1, 1)], "word long, bits long")
    assert pairs(bitmap.either(a, b)) == [(0, 0b1111), (1, 1), (2, -(2**63))]
    assert pairs(bitmap.both(a, b)) == [(0, 0b0101)]
    assert pairs(bitmap.without(a, b)) == [(0, 0b1000), (2, -(2**63))]
    assert [bitmap.digit_count(v, 5) for v in (0, 4, 5, 24, 25, 124, 125)] == [1, 1, 2, 2, 3, 3, 4]
    assert bitmap.optimal_base() == 5


def test_aggregates_over_nothing_and_in_two_levels(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    outputs = {"lo": ("min", "v"), "hi": ("max", "v"), "total": ("sum", "v")}
    assert pairs(rel.in_two_levels(df, F.col("id") % 7, **outputs)) == pairs(rel.aggregate(df, **outputs)) == [(0, 198, 9900)]
    assert rel.in_two_levels(df.where("id < 0"), F.col("id") % 7, **outputs).count() == rel.aggregate(df.where("id < 0"), **outputs).count() == 0


def test_sort_ties_come_reversed(spark):
    df = spark.createDataFrame([(2, 0), (1, 1), (2, 2), (1, 3)], "k int, seq int")
    found = rel.ranked(df, F.col("k"), F.col("seq").desc(), buckets=F.col("k")).orderBy("rank").collect()
    assert [(r["k"], r["seq"]) for r in found] == [(1, 3), (1, 1), (2, 2), (2, 0)]


def merged(runs: list[list[int]]) -> tuple[list[int], list[tuple]]:
    at, out, states = [0] * len(runs), [], []
    while any(i < len(r) for i, r in zip(at, runs)):
        live = [k for k in range(len(runs)) if at[k] < len(runs[k])]
        k = min(live, key=lambda k: (runs[k][at[k]], k))
        out.append(runs[k][at[k]])
        if len(out) % kway.PAGE == 0:
            states += [(len(out) // kway.PAGE - 1, j, at[j] // kway.PAGE, at[j] % kway.PAGE) for j in live]
        at[k] += 1
    return out, states


@pytest.mark.parametrize("sizes", [[4, 4, 4], [0, 25, 3], [10, 10, 10, 10], [31, 1]])
def test_merge_states_equal_a_merge(spark, sizes):
    random.seed(sum(sizes))
    runs = [sorted(random.choices(range(12), k=n)) for n in sizes]
    rows = [(v, k, i) for k, run in enumerate(runs) for i, v in enumerate(run)]
    df = spark.createDataFrame(rows, "value int, run int, pos long")
    out, states = merged(runs)
    assert pairs(kway.merge_states(df, "value", "run", "pos", F.col("value"))) == sorted(states)
    found = kway.sorted_pages(df, "value", [F.col("run"), F.col("pos")], F.col("value")).orderBy("out_page", "out_slot").collect()
    assert [r["value"] for r in found] == out and [r["out_page"] * 10 + r["out_slot"] for r in found] == list(range(len(out)))


def test_runs_of_pages(spark):
    of = lambda pages, k: [r[0] for r in spark.range(pages).select(kway.run_of(F.col("id"), pages, k)).collect()]
    assert of(14, 3) == [0] * 4 + [1] * 4 + [2] * 6
    assert of(2, 3) == [0, 1] and of(3, 3) == [0, 1, 2]


def test_keyed_layout(spark, tmp_path):
    first, second = str(tmp_path / "a"), str(tmp_path / "b")
    keyed.build(spark.createDataFrame([(69, 1, 0), (5, 2, 0), (69, 3, 1)], "k long, v long, seq long"), "k", first, parts=2, seq="seq")
    df = spark.read.parquet(first).select("k", "v")
    assert pairs(keyed.lookup(df, "k", 69)) == [(69, 3)] and keyed.lookup(df, "k", 70).count() == 0
    keyed.insert(spark, first, spark.createDataFrame([(5, 9, 9), (7, 8, 9)], "k long, v long, seq long"), "k", second, parts=2)
    df = spark.read.parquet(second).select("k", "v")
    assert pairs(keyed.range_lookup(df, "k", 0, 100)) == [(5, 9, 1), (7, 8, 2), (69, 3, 3)]
    assert keyed.range_lookup(df, "k", 9, 3).count() == 0


def test_workload_clusters_by_what_saves_most(spark):
    scan = workload.TableScan("t")
    plans = [workload.Join(workload.Filter(scan, {"a": (1, 2)}, 0.5), workload.Filter(scan, {"b": (0, 0)}, 0.1), ("x", "y")), workload.Aggregate(workload.Filter(scan, {"a": (3, 3)}, 0.2), ("z",))]
    assert workload.cluster_column(plans) == "a" and workload.cluster_column([scan]) is None
    df = spark.range(1000).withColumn("a", -F.col("id"))
    bounds = workload.re_clustered(df, plans, 4).groupBy(F.spark_partition_id()).agg(F.min("a"), F.max("a")).collect()
    spans = sorted(tuple(r)[1:] for r in bounds)
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_plans_push_and_prune(spark, tmp_path):
    spark.range(1000).withColumn("v", F.col("id") * 2).withColumn("w", F.lit("x")).write.parquet(str(tmp_path / "t"))
    plan = rel.in_ranges(spark.read.parquet(str(tmp_path / "t")), {"id": (3, 9), "v": (0, 50)}).select("v")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,3)" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan
