from pathlib import Path

import duckdb
import pytest

from millrace import catalogue
from millrace.operators import exchange

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, tables, name):
    found = catalogue.QUERIES[name](spark, DATA)
    wanted = tables.execute(f"SELECT {', '.join(found.columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


@pytest.mark.parametrize(("rows", "bits"), [(48_395, 0), (48_396, 1), (10**6, 5), (4 * 10**6, 7), (10**7, 8), (4 * 10**9, 16)])
def test_radix_bits(rows, bits):
    assert exchange.radix_bits(rows) == bits


def test_negative_keys(spark):
    rows = spark.range(-9, 9).toDF("k")
    found = rows.select(exchange.modulo(rows["k"], 4)).collect()
    assert [r[0] for r in found] == [k % 4 for k in range(-9, 9)]
