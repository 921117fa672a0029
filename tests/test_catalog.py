import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.plans import catalog


def plain(value):
    if value is None or (isinstance(value, float) and value != value):
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def oracle(data):
    connection = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_each_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, data, oracle, name):
    found = catalog.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in found.collect())
    result = oracle.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


def test_time_bounds_reach_the_scan(spark, data):
    plan = catalog.QUERIES["range_scan_week"](spark, data)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_few_columns_are_read(spark, data):
    plan = catalog.QUERIES["stats_f64"](spark, data)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_retention_is_limited_before_the_shuffle(spark, data):
    assert catalog.QUERIES["retain_last_n"](spark, data)._jdf.queryExecution().toString().count("WindowGroupLimit") >= 2


def test_dropped_store_held_every_row(spark, data, tmp_path):
    """Times that start over, equal ones, and ids that repeat."""
    events = spark.read.parquet(f"{data}/events.parquet")
    again = events.withColumn("event_id", F.col("event_id") + 1_000_000)
    events.unionByName(again).unionByName(again.limit(10)).write.parquet(f"{tmp_path}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = connection.execute(catalog.ORACLE_SQL["store_drop"]).fetchall()
    found = catalog.QUERIES["store_drop"](spark, str(tmp_path)).select("rows_after", "rows_before")
    assert [tuple(r) for r in found.collect()] == want == [(0, 2 * events.count() + 10)]
