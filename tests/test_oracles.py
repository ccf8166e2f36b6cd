"""Every query with a DuckDB text gives the same rows at the smallest scale; the others run."""

import datetime
import glob
import os

import duckdb
import pytest

from odresil.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    theirs = sorted((tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        assert a == pytest.approx(b, abs=2e-5) if all(isinstance(v, (int, float)) for v in a + b) else a == b or [x for x, y in zip(a, b) if x != y and not (isinstance(x, float) and abs(x - y) < 2e-5)] == []
