"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""
import duckdb
import pytest

from tessera.plans.registry import all_queries

from conftest import SF001

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, canon  # noqa: E402

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    q = QUERIES[name]
    df = q.build(spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    if q.oracle is None:
        assert df.columns
        return
    res = con.execute(q.oracle)
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(canon(df.columns, rows), key=repr) == sorted(canon(cols, res.fetchall()), key=repr)
