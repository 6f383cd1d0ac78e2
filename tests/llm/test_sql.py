"""Queries with SQL against it, on whole tables."""

import duckdb
import pytest

from tidemark.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = Q.queries()[name](spark, sf)
    cur = con.execute(Q.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = sorted(([r[names.index(c)] for c in df.columns] for r in cur.fetchall()), key=str)
    assert sorted(names) == sorted(df.columns) and sorted(([r[c] for c in df.columns] for r in df.collect()), key=str) == want and want
