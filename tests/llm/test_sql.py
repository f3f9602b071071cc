"""Queries against their DuckDB SQL on the smallest tables."""

import math
from collections import Counter

import pytest

from helpers import SF, TABLES
from pricewake.llm.queries import QUERIES

duckdb = pytest.importorskip("duckdb")


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", [name for name, (_, sql) in QUERIES.items() if sql])
def test_sql(spark, name):
    query, sql = QUERIES[name]
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    twin = db.sql(sql)
    df = query(spark, SF)
    assert sorted(df.columns) == sorted(twin.columns)
    got = rows_of(df.collect(), df.columns)
    assert got and got == rows_of(twin.fetchall(), list(twin.columns))


@pytest.mark.parametrize("name", ["op2_temperature_mix", "op3_license_scan", "op4_line_dedup", "op5_stratified_shards"])
def test_native(spark, name):
    plan = QUERIES[name][0](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
