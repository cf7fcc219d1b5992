"""Every query of the engine against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from corvane import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    cur = db.execute(queries.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(cols, cur.fetchall())
