"""Every query with SQL against DuckDB, over the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SMALL = os.environ.get("SMALL_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, str):
        return v
    return int(v) if float(v) == int(v) else round(float(v), 6)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def names():
    from talkmill.plans.queries import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_against_sql(spark, duck, name):
    from talkmill.plans.queries import QUERIES, SQL

    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    run = duck.execute(SQL[name])
    have = [d[0] for d in run.description]
    theirs = sorted((tuple(plain(r[have.index(c)]) for c in cols) for r in run.fetchall()), key=repr)
    assert sorted(have) == cols and ours == theirs and ours


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
