"""The registered training-data queries run over the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from graphloom.llm import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")
COLUMNS = {"p1_found": ["node_id"], "p2_found": ["node_id"], "p4_found": ["path", "start_byte"], "p6_found": ["node_id", "line_no"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    assert sorted(map(tuple, Q.QUERIES[name](spark, DIR).collect())) == sorted(con.execute(Q.SQL[name]).fetchall())
