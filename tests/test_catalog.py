"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from skein.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(x):
    return "" if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations events".split():
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    res = con.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(map(plain, r)) for r in res.fetchall())
    assert want and sorted(tuple(map(plain, r)) for r in df.select(*cols).collect()) == want


def test_queries_and_sql_go_together():
    assert set(ORACLES) == set(QUERIES)
