"""Registered queries against DuckDB on the smallest tables."""

import math
import re

import duckdb
import pytest

from mapsmith.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "part", "supplier", "orders", "lineitem", "events")


def plain(df):
    columns = sorted(df.columns)
    cell = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(db.sql(ORACLES[name]).df())


def test_every_query_is_named_by_an_inventory_id():
    assert all(re.match(r"(IO|[A-Z])\d+_", n) for n in QUERIES)
