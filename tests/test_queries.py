"""Every query with check SQL gives the SQL's result on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from verify import TABLES, canonical

DATA = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def test_names():
    assert set(SQL) <= set(entry.queries())


#: Long fits; verify.py compares them.
SLOW = {"compare_models", "sweep_features", "model_boost", "model_svm"}


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, DATA)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(SQL[name])
    want = canonical(cur.fetchall(), [c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
