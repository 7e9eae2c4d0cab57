"""The queries with SQL against DuckDB, over the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["p2_found", "p4_found"])
def test_against_sql(spark, name):
    from talkmill.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(theirs) and theirs
    assert set(SQL) == {"p2_found", "p4_found"}
