"""Every registered query with SQL against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from graphloom.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def same(spark, db, query, sql):
    df = query(spark, DIR)
    rows = db.execute(sql)
    cols = [c[0] for c in rows.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    a = Counter(tuple(norm(r[c]) for c in order) for r in df.collect())
    b = Counter(tuple(norm(r[cols.index(c)]) for c in order) for r in rows.fetchall())
    assert a == b


@pytest.mark.parametrize("name", [n for n in registry.sql() if n != "n02_pagerank"])
def test_same_as_sql(spark, db, name):
    same(spark, db, registry.queries()[name], registry.sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.sql().keys()))
def test_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
