"""The registered queries with a DuckDB text give its rows."""

import duckdb
import pytest

from odresil.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, rel = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    mine = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[rel.columns.index(c)] for c in names) for r in rel.fetchall()), key=repr)
    assert mine == theirs and mine
