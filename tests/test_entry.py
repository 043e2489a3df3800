"""Registered queries against DuckDB, on the smallest tables, and the driver's contract."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from quarrylab import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return connection


def plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else str(round(x, 6)) if isinstance(x, float) else str(x)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), want.columns)


def test_whole_tables(spark, duck):
    """As many rows as the tables have, with both kinds of unmatched rows."""
    assert catalog.QUERIES["rows_no_blobs_all"](spark, SF).count() == duck.sql("SELECT count(*) FROM embeddings").fetchall()[0][0]
    joined = catalog.QUERIES["sql_join_full_all"](spark, SF)
    assert joined.where("c_custkey IS NOT NULL").count() == duck.sql("SELECT count(*) FROM customer").fetchall()[0][0]
    assert joined.where("s_suppkey IS NOT NULL").count() == duck.sql("SELECT count(*) FROM supplier").fetchall()[0][0]
    assert joined.where("c_custkey IS NULL").count() and joined.where("s_suppkey IS NULL").count()


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    """What the plans promise: filters and columns at the scan, a top-k in place of a sort, keys alone in a shuffle."""
    filtered = plan(catalog.QUERIES["rows_project_filter"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in filtered and "o_orderdate" not in filtered
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["rows_topk"](spark, SF))
    assert "In(o_orderkey" in plan(catalog.QUERIES["rows_by_id_list"](spark, SF))
    assert "partial_min" in plan(catalog.QUERIES["dedup_keep_first"](spark, SF))
