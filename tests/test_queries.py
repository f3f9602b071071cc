"""Every registered query against its SQL twin on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_point

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


# Too many pairs for SQL; held to brute force in test_similarity.
WITHOUT_TWIN = {"crowded_match"}
# The queries of the library itself; those of optional folders have tests there.
NAMES = sorted({name for module in entry_point._MODULES for name in module.QUERIES} - WITHOUT_TWIN)


def test_all_queries_have_a_twin():
    assert {*NAMES, *WITHOUT_TWIN} <= set(entry_point.queries())
    assert set(NAMES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = entry_point.queries()[name](spark, str(SF))
    twin = db.sql(entry_point.oracle_sql()[name])
    columns = list(twin.columns)
    assert sorted(df.columns) == sorted(columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "Window" not in plan
    # One row beside one row is all that may be joined without a key.
    assert "NestedLoop" not in plan or name == "alert_summary"
    got = bag(df.collect(), df.columns)
    assert got == bag(twin.fetchall(), columns)
    assert got


def test_entry(spark):
    assert entry_point.entry(spark).count() >= 0
