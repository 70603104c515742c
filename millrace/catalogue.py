"""The queries over the synthetic tables, by name, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators import bitmap, exchange, joins, keyed, kway
from .operators import relational as rel
from .plans import workload
from .replay import buffer, locks
from .sources.versions import CHUNK, ROW, VersionedTable
from .workspace import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None, name: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Tables(spark, folder))

        QUERIES[name or f.__name__] = run
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


@query("SELECT min(l_quantity) AS min_quantity, max(l_extendedprice) AS max_price, CAST(sum(l_linenumber) AS BIGINT) AS sum_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey BETWEEN 100 AND 900 AND l_quantity BETWEEN 10 AND 20 HAVING count(*) > 0")
def flagship(t):
    orders = rel.in_ranges(t("orders"), {"o_orderkey": (100, 900)}).select("o_orderkey")
    lines = rel.in_ranges(t("lineitem"), {"l_quantity": (10, 20)}).select("l_orderkey", "l_quantity", "l_extendedprice", "l_linenumber")
    return rel.aggregate(rel.hash_join(orders, lines, "o_orderkey", "l_orderkey"), min_quantity=("min", "l_quantity"), max_price=("max", "l_extendedprice"), sum_line=("sum", "l_linenumber"))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def scan_project(t):
    return t("customer").select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN 0.05 AND 0.07")
def filter_conjunctive_range(t):
    return rel.in_ranges(t("lineitem"), {"l_quantity": (10.0, 20.0), "l_discount": (0.05, 0.07)}).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_equality(t):
    return rel.in_ranges(t("orders"), {"o_orderstatus": ("F", "F")}).select("o_orderkey")


_CHUNKS = "SELECT o_orderkey // 1000 AS chunk, min(o_custkey) AS min_o_custkey, max(o_custkey) AS max_o_custkey, min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1"


@query(_CHUNKS)
def chunk_stats(t):
    return rel.chunk_stats(t("orders"), F.expr("o_orderkey div 1000"), ["o_custkey", "o_totalprice"])


@query(f"SELECT chunk FROM ({_CHUNKS}) WHERE 3 BETWEEN min_o_custkey AND max_o_custkey")
def prune_eq(t):
    return rel.prune(chunk_stats(t), {"o_custkey": (3, 3)})


@query(f"SELECT chunk FROM ({_CHUNKS}) WHERE min_o_totalprice <= 1200 AND max_o_totalprice >= 900")
def prune_range(t):
    return rel.prune(chunk_stats(t), {"o_totalprice": (900.0, 1200.0)})


@query("SELECT min(l_quantity) AS lo, max(l_extendedprice) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def agg_global(t):
    return rel.aggregate(t("lineitem"), lo=("min", "l_quantity"), hi=("max", "l_extendedprice"), total=("sum", "l_linenumber"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem WHERE l_quantity < 0 HAVING count(*) > 0")
def agg_empty(t):
    return rel.aggregate(t("lineitem").where("l_quantity < 0"), total=("sum", "l_linenumber"))


_JOIN = "SELECT o_orderkey, o_custkey, l_partkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query(_JOIN)
def hash_join_unique(t):
    return rel.hash_join(t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), "o_orderkey", "l_orderkey").drop("l_orderkey")


@query(_JOIN)
def join_replication(t):
    return rel.replication_join(t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), t("orders").select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey").drop("l_orderkey")


def _dup(order: str) -> str:
    return f"SELECT s_suppkey, c_custkey FROM supplier JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey {order}) AS r FROM customer) ON r = 1 AND c_nationkey = s_nationkey"


def _by_nation(t, which):
    return rel.hash_join(t("customer").select("c_nationkey", "c_custkey"), t("supplier").select("s_suppkey", "s_nationkey"), "c_nationkey", "s_nationkey", duplicates=which, seq="c_custkey").select("s_suppkey", "c_custkey")


@query(_dup("DESC"))
def hash_join_last(t):
    return _by_nation(t, "last")


@query(_dup("ASC"))
def radix_join_first(t):
    return _by_nation(t, "first")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000)")
def semi_join_reduction(t):
    return rel.semi_join_reduction(t("customer").select("c_custkey"), t("orders").where("o_totalprice > 1000"), "c_custkey", "o_custkey")


_HISTOGRAM = "SELECT o_custkey & 31 AS bucket, count(*) AS n FROM orders GROUP BY 1"


@query(_HISTOGRAM)
def radix_histogram(t):
    return exchange.histogram(t("orders"), F.col("o_custkey").bitwiseAND(F.lit(31)))


@query(f"SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_place FROM ({_HISTOGRAM})")
def radix_offsets(t):
    return exchange.offsets(radix_histogram(t))


@query("SELECT (((o_orderkey - 7000) % 8) + 8) % 8 AS bucket, count(*) AS n FROM orders GROUP BY 1")
def repartition_pmod(t):
    return exchange.histogram(t("orders"), exchange.modulo(F.col("o_orderkey") - 7000, 8))


@query("SELECT CAST(0 AS BIGINT) AS misplaced")
def exchange_placement(t):
    placed = exchange.repartitioned(t("orders").select("o_orderkey"), "o_orderkey", 8)
    seen = placed.withColumn("at", F.spark_partition_id())
    return seen.agg(F.count_if(F.col("at") != exchange.modulo(F.col("o_orderkey"), 8)).alias("misplaced"))


@query("SELECT n_nationkey, CAST(peer AS INTEGER) AS peer FROM nation, range(4) AS r(peer)")
def replicate_rows(t):
    return exchange.replicated(t("nation").select("n_nationkey"), 4)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey DESC) AS rank FROM part")
def sort_ties_reversed(t):
    return rel.ranked(t("part").select("p_partkey", "p_size"), F.col("p_size"), F.col("p_partkey").desc(), buckets=F.col("p_size")).select("p_partkey", "rank")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def btree_upsert(t):
    return rel.upserted(t("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").drop("event_id")


def _layout(t) -> DataFrame:
    path = f"{shared_folder(t.spark)}/keyed-{uuid.uuid4().hex}"
    keyed.build(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", path, parts=8)
    return t.spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders WHERE o_orderkey BETWEEN 10 AND 90")
def btree_range(t):
    return keyed.range_lookup(_layout(t), "o_orderkey", 10, 90)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 69")
def btree_lookup(t):
    return keyed.lookup(_layout(t), "o_orderkey", 69)


@query("SELECT p_partkey AS row_id FROM part WHERE p_size BETWEEN 40 AND 80")
def bitmap_naive_range(t):
    return bitmap.row_ids(bitmap.lookup(bitmap.naive(t("part"), "p_size", "p_partkey"), 40, 80))


@query("SELECT p_partkey AS row_id FROM part WHERE p_size BETWEEN 3 AND 9")
def bitmap_range_encoded(t):
    return bitmap.row_ids(bitmap.range_encoded_lookup(bitmap.range_encoded(t("part"), "p_size", "p_partkey"), 3, 9))


@query("SELECT p_partkey AS row_id FROM part WHERE p_size BETWEEN 7 AND 33")
def bitmap_decomposed(t):
    return bitmap.row_ids(bitmap.decomposed_lookup(bitmap.decomposed(t("part"), "p_size", "p_partkey", bitmap.optimal_base(), 50), 7, 33, bitmap.optimal_base(), 50))


@query("SELECT place, CAST(p_size // CAST(5 ** place AS BIGINT) % 5 AS BIGINT) AS digit, count(*) AS n FROM part, (SELECT unnest([0, 1, 2])::INTEGER AS place) GROUP BY 1, 2")
def bitmap_digit_counts(t):
    return bitmap.digit_counts(bitmap.decomposed(t("part"), "p_size", "p_partkey", 5, 50))


@query("SELECT p_partkey AS row_id FROM part WHERE (p_size BETWEEN 3 AND 30 OR p_size = 50) AND p_size NOT BETWEEN 10 AND 12 AND p_retailprice > 950")
def bitmap_algebra(t):
    index = bitmap.naive(t("part"), "p_size", "p_partkey")
    dear = bitmap.lookup(bitmap.naive(t("part").withColumn("dear", (F.col("p_retailprice") > 950).cast("int")), "dear", "p_partkey"), 1, 1)
    rows = bitmap.without(bitmap.either(bitmap.lookup(index, 3, 30), bitmap.lookup(index, 50, 50)), bitmap.lookup(index, 10, 12))
    return bitmap.row_ids(bitmap.both(rows, dear))


@query("SELECT min(l_quantity) AS lo, max(l_extendedprice) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def agg_two_level(t):
    return rel.in_two_levels(t("lineitem"), F.expr("l_orderkey div 1000"), lo=("min", "l_quantity"), hi=("max", "l_extendedprice"), total=("sum", "l_linenumber"))


_PAIRS = "SELECT o_orderkey, event_id FROM events JOIN (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ON r = 1 AND o_custkey = user_id"


@query(_PAIRS)
def radix_join_pairs(t):
    return joins.radix_join(t("orders").select("o_custkey", "o_orderkey"), t("events").select("user_id", "event_id"), "o_custkey", "user_id", seq="o_orderkey", bits=5).select("o_orderkey", "event_id")


@query("SELECT CAST(rows AS BIGINT) AS rows, CAST(bits AS BIGINT) AS bits FROM (VALUES (48395, 0), (48396, 1), (1000000, 5), (4000000, 7), (10000000, 8), (4000000000, 16)) AS v(rows, bits)")
def radix_bits(t):
    sizes = (48_395, 48_396, 1_000_000, 4_000_000, 10_000_000, 4_000_000_000)
    return t.spark.createDataFrame([(n, exchange.radix_bits(n)) for n in sizes], "rows long, bits long")


@query("SELECT CAST(((CAST(i % 10000 AS HUGEINT) * 11400714819323198485) % 18446744073709551616 // 4294967296) & 63 AS BIGINT) AS slot, count(*) AS n FROM range(20000) AS r(i) GROUP BY 1")
def hash_slots(t):
    return t.spark.range(20_000).groupBy(exchange.slot(F.col("id") % 10_000, 64).alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT CAST((o_custkey % 10000) % 16 % 3 AS INTEGER) AS node, count(*) AS n FROM orders GROUP BY 1")
def shuffle_two_level(t):
    rows = exchange.shuffled(t("orders").select((F.col("o_custkey") % 10_000).alias("key")), "key", 16, 3)
    return exchange.histogram(rows.where(F.spark_partition_id() == F.col("node")), F.col("node")).withColumnRenamed("bucket", "node")


@query("SELECT CAST(0 AS BIGINT) AS misplaced, count(*) AS n, CAST(sum(o_custkey & 31) AS BIGINT) AS buckets FROM orders")
def radix_partitions(t):
    rows = exchange.radix_partitioned(t("orders").select("o_custkey"), "o_custkey", 5)
    return rows.withColumn("at", F.spark_partition_id()).agg(F.count_if(F.col("at") != F.col("bucket")).alias("misplaced"), F.count("*").alias("n"), F.sum("bucket").cast("long").alias("buckets"))


@query(_JOIN)
def join_symmetric(t):
    left, right = t("orders").select("o_orderkey", "o_custkey"), t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return joins.symmetric_join(left, right, "o_orderkey", "l_orderkey", 8).drop("l_orderkey")


@query(_JOIN)
def join_asymmetric(t):
    left, right = exchange.dealt(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 8), t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return joins.asymmetric_join(left, right, "o_orderkey", "l_orderkey").drop("l_orderkey")


@query("SELECT event_id, (r - 1) // 10 AS out_page, (r - 1) % 10 AS out_slot FROM (SELECT event_id, row_number() OVER (ORDER BY user_id, event_id) AS r FROM events)")
def kway_sort(t):
    return kway.sorted_pages(t("events").select("event_id", "user_id"), "user_id", [F.col("event_id")], F.col("user_id")).select("event_id", "out_page", "out_slot")


_RUNS = "SELECT user_id AS value, CAST(event_id % 3 AS INTEGER) AS run, row_number() OVER (PARTITION BY event_id % 3 ORDER BY user_id, event_id) - 1 AS pos FROM events"


@query(f"""
WITH runs AS ({_RUNS}), ranked AS (SELECT *, row_number() OVER (ORDER BY value, run, pos) AS rank FROM runs),
total AS (SELECT run, count(*) AS length, list(rank ORDER BY rank) AS ranks FROM ranked GROUP BY run),
pages AS (SELECT rank // 10 - 1 AS out_page, rank FROM ranked WHERE rank % 10 = 0),
states AS (SELECT out_page, run, length, len(list_filter(ranks, lambda x: x < rank)) AS stands FROM pages, total)
SELECT out_page, run, CAST(stands // 10 AS BIGINT) AS page, CAST(stands % 10 AS BIGINT) AS slot FROM states WHERE stands < length
""")  # fmt: skip
def kway_merge_states(t):
    run = F.pmod("event_id", F.lit(3)).cast("int")
    rows = t("events").select(F.col("user_id").alias("value"), run.alias("run"), "event_id")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy("value", "event_id")).cast("long") - 1)
    return kway.merge_states(rows, "value", "run", "pos", F.col("value"))


#: What each version holds, by the changes below
_V1 = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
_V2 = f"SELECT * FROM ({_V1}) WHERE o_custkey % 7 <> 0"
_V3 = f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 = 4 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM ({_V2})"
_V4 = f"SELECT * FROM ({_V3}) WHERE o_orderkey // 1000 <> 0"
_STATES = (f"{_V1} WHERE false", _V1, _V2, _V3, _V4)
_versioned: dict[tuple[str, str], VersionedTable] = {}


def versioned(t) -> VersionedTable:
    """Orders in chunks of 1,000 keys: inserted, rows deleted, rows updated, a chunk deleted. Built once a session and folder."""
    key = t.spark.sparkContext.applicationId, t.folder
    if key not in _versioned:
        orders = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        table = VersionedTable.create(t.spark, f"{shared_folder(t.spark)}/versions-{uuid.uuid4().hex}", orders.schema)
        change = table.modify()
        change.insert(orders, F.expr("o_orderkey div 1000"), F.col("o_orderkey"))
        change.commit()
        change = table.modify()
        change.delete(table.rows(table.chunks()).where("o_custkey % 7 = 0").select(CHUNK, ROW))
        change.commit()
        change = table.modify()
        price = F.when(F.col("o_orderkey") % 10 == 4, F.lit(-1.0))
        change.update(table.rows(table.chunks()).where("o_orderkey % 10 IN (3, 4)").select(CHUNK, ROW, price.alias("o_totalprice")))
        change.commit()
        change = table.modify()
        change.delete_chunks(table.contains({"o_orderkey": 5}))
        change.commit()
        _versioned[key] = table
    return _versioned[key]


def _at(version: int):  # noqa: ANN202
    @query(_STATES[min(version, 4)], f"time_travel_v{version}")
    def travel(t):  # noqa: ANN001, ANN202
        return versioned(t).read(version)


for _v in (0, 1, 2, 3, 4, 9):
    _at(_v)


@query(" UNION ALL ".join(f"SELECT {v} AS version, count(DISTINCT o_orderkey // 1000) AS chunks, count(*) AS n_rows FROM ({s})" for v, s in enumerate(_STATES)))
def version_files(t):
    table = versioned(t)
    found = [(v, list(table.chunks(v).values())) for v in range(5)]
    return t.spark.createDataFrame([(v, len(c), sum(n for n, _ in c)) for v, c in found], "version int, chunks long, n_rows long")


@query(f"SELECT * FROM ({_V3}) WHERE o_orderkey BETWEEN 1200 AND 3100 AND o_custkey BETWEEN 5 AND 900")
def prune_then_scan(t):
    return versioned(t).read(3, {"o_orderkey": (1200, 3100), "o_custkey": (5, 900)})


@query("SELECT 'l_quantity' AS clustered_by, count(*) AS n FROM lineitem")
def re_cluster(t):
    plans = [workload.Filter(workload.TableScan("lineitem"), {"l_quantity": (1, 5)}, 0.1), workload.Aggregate(workload.Filter(workload.TableScan("lineitem"), {"l_discount": (0, 0.05)}, 0.5), ("l_tax",))]
    return workload.re_clustered(t("lineitem"), plans, 8).agg(F.lit(workload.cluster_column(plans)).alias("clustered_by"), F.count("*").alias("n"))


_COMPATIBLE = ", ".join(f"('{a}', {h}, {g})" for a in locks.MODES for h, g in [("NULL", "true"), *((f"'{h}'", str(h in locks.COMPATIBLE[a]).lower()) for h in locks.MODES)])


@query(f"SELECT * FROM (VALUES {_COMPATIBLE}) AS v(asked, held, granted)")
def mgl_compat(t):
    return locks.compatibility(t.spark)


@query("""
WITH e AS (SELECT event_type, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY event_type, user_id ORDER BY i) AS before FROM e)
SELECT a.event_type, a.event_id, a.before IS NOT NULL AND count(DISTINCT b.user_id) < 20 AS hit
FROM p a LEFT JOIN e b ON a.event_type = b.event_type AND b.i > a.before AND b.i < a.i GROUP BY a.event_type, a.event_id, a.before
""")  # fmt: skip
def lru_hits(t):
    return buffer.replayed(t("events"), "event_type", "event_id", "user_id", 20).select("event_type", "event_id", "hit")


@query(None)
def clock_evictions(t):
    return buffer.replayed(t("events"), "event_type", "event_id", "user_id", 20, "clock").select("event_type", "event_id", "hit", "evicted")


@query(None)
def lock_replay(t):
    action = F.when(F.col("event_id") % 3 == 2, "release").when(F.col("event_id") % 2 == 0, locks.READ).otherwise(locks.WRITE)
    rows = t("events").select(F.pmod("user_id", F.lit(16)).alias("obj"), "event_id", F.pmod("event_id", F.lit(5)).alias("transaction"), action.alias("action"))
    return locks.replayed(rows, "obj", "event_id", "transaction", "action")


@query(None)
def mgl_replay(t):
    action = F.when(F.col("event_id") % 4 == 3, "release").when(F.col("event_id") % 3 == 0, "X").otherwise("S")
    path = F.concat_ws("/", F.lit("db"), F.pmod("user_id", F.lit(3)), F.pmod("event_id", F.lit(7)))
    rows = t("events").select("event_type", "event_id", F.pmod("event_id", F.lit(5)).alias("transaction"), path.alias("path"), action.alias("action"))
    return locks.tree_replayed(rows, "event_type", "event_id", "transaction", "path", "action")
