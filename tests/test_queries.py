"""Every query of the library against its SQL."""

import os

import duckdb
import pytest
from larkspur.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df, r = QUERIES[name](spark, sf_dir), duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    order = [r.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x) for x in row) for row in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
