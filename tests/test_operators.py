"""Operators whose results SQL cannot express, and golden values."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.functions import sql_guard
from graphloom.operators import analytics as N
from graphloom.operators import delta as D
from graphloom.operators import finders as FI
from graphloom.operators import linearize
from graphloom.operators import retrieval as R
from graphloom.operators import temporal as T
from graphloom.operators import traversal as TR
from graphloom.operators.graph_tables import merge_edges, merge_nodes
from graphloom.plans import graph_queries
from graphloom.runtime import Staging


def edges_df(spark, pairs, type_="CALLS"):
    return spark.createDataFrame([(f"{a}->{b}", a, b, type_, 1.0) for a, b in pairs], "id string, src string, dst string, type string, confidence double")


def test_pagerank_golden(spark):
    chain = [(x, y) for x, y in zip("ABCDEFGHI", "BCDEFGHIJ")] + [("J", "A"), ("E", "C"), ("G", "C"), ("I", "C")]
    got = {r.id: r.rank for r in N.pagerank(edges_df(spark, chain), cut_every=25).collect()}
    # fixed values: ranks to twelve digits for damping 0.85 and 50 rounds
    want = {"A": .049554746740, "B": .057121529838, "C": .201119765898, "D": .185951757181, "E": .173059036759,
            "F": .088550082051, "G": .090267559225, "H": .053363725551, "I": .060359151290, "J": .040652645466}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-11 for k in want)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"a{rng.randrange(60)}", f"a{rng.randrange(60)}") for _ in range(45)] + [("z1", "z1"), (f"c{0}", "c1")] + [(f"c{i}", f"c{i + 1}") for i in range(20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in N.components(edges_df(spark, pairs)).collect()}
    assert got == {x: find(x) for x in root}


def test_components_take_all_edges(spark, tmp_path):
    calls, holds = edges_df(spark, [("a", "b"), ("c", "b")]), edges_df(spark, [("c", "d"), ("x", "y")], "HAS_METHOD")
    calls.unionByName(holds).write.parquet(str(tmp_path / "edges.parquet"))
    got = {r.id: r.component for r in graph_queries.QUERIES["n05_components"](spark, str(tmp_path)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"), ("h", "a")]
    got = {r.id: r.component for r in N.strong_components(edges_df(spark, pairs)).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "g": "g"}


def test_bounds_are_not_passed_in_silence(spark):
    ring = edges_df(spark, [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)])
    pairs = ring.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    with pytest.raises(RuntimeError):
        N._reach(Staging(spark, "test"), pairs, max_rounds=5)
    with pytest.raises(RuntimeError):
        N.strong_components(ring, max_rounds=1)
    with pytest.raises(RuntimeError):
        N.components(ring, max_rounds=1)
    with pytest.raises(RuntimeError):
        linearize.linearise(spark.createDataFrame([(f"c{i + 1}", f"c{i}", 0) for i in range(5)], "child string, parent string, pos int"), max_levels=3)


def test_communities_are_stable_and_large_enough(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(5) if i < j]
    e = edges_df(spark, clique("a") + clique("b") + [("x", "y")])
    one = {r.id: r.community for r in N.communities(e).collect()}
    assert one == {f"{p}{i}": f"{p}0" for p in "ab" for i in range(5)}


def test_overrides_take_the_nearest(spark, make):
    ids = lambda c, m: f"{c}.{m}"
    nodes = make("nodes", [{"id": ids(c, m), "kind": "Method", "name": m} for c, m in [("A", "run"), ("B", "run"), ("C", "run"), ("C", "stop"), ("A", "stop")]])
    edges = edges_df(spark, [("B", "A"), ("C", "B")], "EXTENDS").unionByName(edges_df(spark, [("A", "A.run"), ("B", "B.run"), ("C", "C.run"), ("C", "C.stop"), ("A", "A.stop")], "HAS_METHOD"))
    got = {tuple(r) for r in N.overrides(nodes, edges).collect()}
    assert got == {(m, o, "METHOD_OVERRIDES", 0.9) for m, o in (("B.run", "A.run"), ("C.run", "B.run"), ("C.stop", "A.stop"))}
    # what an interface declares is implemented, by every class below it
    faces = nodes.unionByName(make("nodes", [{"id": "A", "kind": "Interface"}]))
    got = {tuple(r) for r in N.overrides(faces, edges).collect()}
    assert got == {("C.run", "B.run", "METHOD_OVERRIDES", 0.9)} | {(m, o, "METHOD_IMPLEMENTS", 0.95) for m, o in (("B.run", "A.run"), ("C.run", "A.run"), ("C.stop", "A.stop"))}


def test_traverse_takes_the_smallest_shortest_path(spark):
    e = edges_df(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("ab", "a"), ("d", "dd")])
    start = spark.createDataFrame([("a",)], "start string")
    got = {(r.node_id, r.depth, tuple(r.path)) for r in TR.traverse(e, start, None, "down", 3).collect()}
    assert got == {("b", 1, ("a", "b")), ("c", 1, ("a", "c")), ("d", 2, ("a", "b", "d")), ("dd", 3, ("a", "b", "d", "dd"))}
    assert TR.traverse(e, start, None, "down", 0).count() == 0


def test_cochange_fixture(spark):
    rows = [("1", f) for f in "ab"] + [("2", f) for f in "ab"] + [("3", f) for f in "ac"] + [("4", f) for f in "de"]
    c = spark.createDataFrame([(s, f, "x", 1_700_000_100 + 100 * (int(s) - 1)) for s, f in rows], "sha string, file string, author string, ct long")
    got = {(r.source_file, r.target_file): (r.cocommit_count, r.total_commits_source, r.total_commits_target, r.lift) for r in T.cochange(c).collect()}
    assert got == {("a", "b"): (2, 3, 2, 1.3333), ("a", "c"): (1, 3, 1, 1.3333), ("d", "e"): (1, 1, 1, 4.0)}


def test_merging_rules(make):
    n = make("nodes", [{"id": "a", "kind": "File"}, {"id": "a", "kind": "File", "name": "x"}, {"id": None, "kind": "File"}])
    assert [r.name for r in merge_nodes(n).collect()] == ["x"]
    e = make("edges", [{"id": "1", "src": "a", "confidence": None}, {"id": "1", "src": "a", "confidence": 0.5}, {"id": "1", "src": "a", "confidence": 0.2}])
    assert [r.confidence for r in merge_edges(e).collect()] == [0.5]


def test_finders_on_empty_lists(make):
    n = make("nodes", [{"id": "a", "kind": "File"}])
    assert FI.list_nodes(n, []).count() == 0 and FI.list_nodes(n, None).count() == 1
    e = make("edges", [{"id": "1", "src": "a", "dst": "b", "type": "CALLS", "confidence": 0.5}])
    assert FI.list_edges(e, []).count() == 1 and FI.list_edges(e, min_confidence=0.6).count() == 0


def test_baseline_states(spark):
    s = "k string, v string"
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), (None, "1")], s)
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), (None, "1")], s)
    got = {(r.k, r.state) for r in D.baseline(old, new, ["k"], ["v"]).collect()}
    assert got == {("a", "unchanged"), ("b", "updated"), ("c", "fixed"), ("d", "new"), (None, "unchanged")}


def test_fusion_ties_and_bad_k(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, id string, pos int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2), (1, "z", 3)], "qid int, id string, pos int")
    assert [r.id for r in R.fuse(a, b).orderBy("pos").collect()] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        R.fuse(a, k=0)


def test_scalars(spark):
    df = spark.createDataFrame([("/users/:id?x=1/", "arn:aws:sns:eu:1:topic", -2.5)], "p string, t string, v double")
    r = df.select(X.norm_path(F.col("p")).alias("p"), X.norm_topic(F.col("t")).alias("t"), X.round_up(F.col("v"), 0).alias("v")).first()
    assert (r.p, r.t, r.v) == ("/users/{id}", "topic", -2.0)
    import re

    assert re.match(X.glob_regex("src/**/*.ts"), "src/a/b.ts") and not re.match(X.glob_regex("src/*.ts"), "src/a/b.ts")


@pytest.mark.parametrize("bad", ["DROP TABLE x", "select 1; select 2", "", "insert into t values (1)", "with a as (select 1) delete from t", "select * from parquet.`/etc`", "select reflect('a', 'b')"])
def test_guard_refuses(bad):
    with pytest.raises(sql_guard.NotReadOnly):
        sql_guard.check(bad)


def test_guard_runs(spark):
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("t")
    assert sql_guard.run(spark, "SELECT a, 'drop; table' AS s FROM t WHERE a = :x", {"x": 1}).count() == 1
    assert sql_guard.check("select replace(s, 'a', 'b') from t")


def test_c3_orders(spark):
    from graphloom.operators.linearize import c3, linearise

    assert c3("D", [["B", "A"], ["C", "A"]]) == ["D", "B", "C", "A"]
    assert c3("X", [["A", "B"], ["B", "A"]]) is None
    rows = [("B", "A", 0), ("C", "A", 0), ("D", "B", 0), ("D", "C", 1), ("E", "D", 0), ("p", "q", 0), ("q", "p", 0), ("r", "q", 0), (None, "A", 0)]
    got = {r.cls: r.mro for r in linearise(spark.createDataFrame(rows, "child string, parent string, pos int")).collect()}
    assert got == {"A": ["A"], "B": ["B", "A"], "C": ["C", "A"], "D": ["D", "B", "C", "A"], "E": ["E", "D", "B", "C", "A"]}


def test_strategies_of_resolution(spark):
    from graphloom.operators import linearize as LZ

    links = spark.createDataFrame([("d", "b", 0), ("d", "c", 1), ("b", "a", 0), ("c", "a", 0)], "child string, parent string, pos int")
    order = lambda s: {r.cls: list(r.mro) for r in LZ.linearise(links, strategy=s).collect()}["d"]
    assert order("c3") == ["d", "b", "c", "a"] and order("first-wins") == ["d", "b", "a", "c"] and order("single") == ["d", "b", "a"] and order("none") == ["d"]
    with pytest.raises(KeyError):
        LZ.linearise(links, strategy="other")


def test_closure_walks_all_changed_files_as_one_set(spark, monkeypatch):
    rows = []

    def counted(self, df, name, by=None, cut=Staging.cut):
        out = cut(self, df, name, by)
        rows.append(out.count())
        return out

    monkeypatch.setattr(Staging, "cut", counted)
    # 100 changed files import one hub, so each reaches all others in two steps: 10,000 pairs, 103 files
    pairs = [(f"t{i}", "hub") for i in range(100)] + [("hub", "far"), ("far", "beyond"), ("t0", "t0"), ("t1", None), ("x", "t1")]
    e = edges_df(spark, pairs, "IMPORTS")
    changed = spark.createDataFrame([(f"t{i}",) for i in range(100)] + [("t0",), ("alone",)], "file string")
    got = {r.file: r.depth for r in TR.closure(e, changed, 2).collect()}
    assert got == {f"t{i}": 0 for i in range(100)} | {"alone": 0, "hub": 1, "x": 1, "far": 2}
    assert sum(rows) < 500
    assert {r.file for r in TR.closure(e, changed, 0).collect()} == {f"t{i}" for i in range(100)} | {"alone"}
