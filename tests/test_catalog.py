"""Every query of the catalogue against its SQL in an independent engine."""

import glob
import os

import duckdb
import pytest

from stratakeep.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(str(v).lower() if isinstance(v, bool) else v for v in r) for r in got.collect()]) == rows(names, [tuple(str(v).lower() if isinstance(v, bool) else v for v in r) for r in want.fetchall()])


def test_bloom_has_no_false_negatives(spark):
    found = {r["key"]: r["might_contain"] for r in QUERIES["kv_bloom_might_contain"](spark, DATA).collect()}
    assert all(v for k, v in found.items() if int(k) % 2 == 0)
    assert sum(v for k, v in found.items() if int(k) % 2) < 0.05 * len(found)


def test_key_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from stratakeep.plans.changelog import change_log
    from stratakeep.plans.replay import state

    c = spark.read.parquet(f"{DATA}/customer.parquet")
    plan = state(change_log(c, "c_custkey", "c_name", "c_acctbal"), 0).where(F.col("key") == "Customer#000000001")._jdf.queryExecution().toString()
    assert "EqualTo(c_name,Customer#000000001)" in plan
