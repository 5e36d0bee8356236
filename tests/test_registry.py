"""Every registered query runs on whole tables, equals its SQL, and has a plan without all-pairs joins."""

import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_oracle import rows_of  # noqa: E402

from earmark.plans.registry import load_all  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
INVENTORY = (
    [f"S{i}" for i in range(1, 20)] + [f"P{i}" for i in range(1, 13)] + [f"F{i}" for i in range(1, 22)] + [f"J{i}" for i in range(1, 16)]
    + [f"A{i}" for i in range(1, 26)] + [f"W{i}" for i in range(1, 8)] + [f"T{i}" for i in range(1, 5)] + [f"U{i}" for i in range(1, 5)]
    + [f"M{i}" for i in range(1, 4)] + [f"V{i}" for i in range(1, 13)] + ["R1"] + [f"X{i}" for i in range(1, 6)])
QUERIES = load_all()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_inventory_is_covered():
    covered = {c for q in QUERIES.values() for c in q.covers}
    assert sorted(set(INVENTORY) - covered) == [] and sorted(covered - set(INVENTORY)) == []


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    df = contract.entry(spark)
    assert df.count() == 30 and "ndcg_at_k" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    q = QUERIES[name]
    df = q.run(spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = [tuple(r) for r in df.collect()]
    if q.sql is not None:
        cursor = db.execute(q.sql)
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, cursor.fetchall())
