"""Networks whose grid has more than 1,000 rows, where the SQL's numbers stand for several places each."""

import duckdb
import pytest

from mapsmith.plans.catalog import ORACLES, QUERIES
from tests.test_catalog import plain


@pytest.mark.parametrize("name", ["N19_connection_codes", "N20_prune_dead_ends"])
def test_same_as_duckdb_beyond_a_thousand_rows(spark, tmp_path, name):
    duckdb.sql(f"COPY (SELECT k o_orderkey, '1-URGENT' o_orderpriority FROM (SELECT unnest(range(200)) k UNION ALL SELECT unnest(range(61000, 61200)))) TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    assert plain(QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(db.sql(ORACLES[name]).df())
