"""Readers, the store and streams on small fixtures."""

import json
import os
from datetime import datetime

import pytest

from graphloom.runtime import Staging, clean_staging, shared_dir, small
from graphloom.sources import readers as S
from graphloom.sources.store import GraphStore, changed, upsert
from graphloom.streaming import events as EV


def texts(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "text string")


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"ab\x00cd")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/c.js").write_text("x")
    got = [(r.path, r.language, r.is_binary, r.content) for r in S.scan_repo(spark, str(tmp_path)).orderBy("path").collect()]
    assert got == [("b.bin", None, True, None), ("src/a.py", "python", False, "x = 1\n")]


def test_git_log(spark):
    log = "\x01aa\x02100\x02A@x.example\x02feat: one\n\na.py\nb.py\n\x01bb\x02200\x02b@x.example\x02merge\n"
    got = [tuple(r) for r in S.git_log(texts(spark, log)).orderBy("sha", "file").collect()]
    assert got == [("aa", 100, "a@x.example", "feat: one", "a.py"), ("aa", 100, "a@x.example", "feat: one", "b.py"), ("bb", 200, "b@x.example", "merge", None)]


def test_hunks(spark):
    d = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@ def f\n+a\n@@ -9 +10 @@\n-b\ndiff --git a/y b/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    assert {tuple(r) for r in S.diff_hunks(texts(spark, d)).collect()} == {("x.py", 1, 3), ("x.py", 10, 1)}


def test_lcov(spark):
    r = S.lcov(texts(spark, "TN:\nSF:a.py\nDA:1,1\nDA:2,0\nDA:2,3\nDA:3,0\nend_of_record\nSF:b.py\nDA:1,0\nend_of_record\n")).orderBy("file").collect()
    assert [(x.file, x.total, x.covered, list(x.covered_lines)) for x in r] == [("a.py", 3, 2, [1, 2]), ("b.py", 1, 0, [])]


def test_sarif(spark):
    log = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "s"}}, "results": [
        {"ruleId": "r1", "message": {"text": "m"}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 4}}}]},
        {"ruleId": "r2", "level": "error", "message": {"text": "n"}, "suppressions": [{"kind": "external"}]}]}]}
    got = [tuple(r) for r in S.sarif(texts(spark, json.dumps(log))).orderBy("rule_id").collect()]
    assert got == [("s", "r1", "warning", "m", "a.py", 4, False), ("s", "r2", "error", "n", None, 1, True)]


def test_manifests(spark):
    f = spark.createDataFrame([
        ("a/package.json", json.dumps({"dependencies": {"x": "^1.0"}})), ("requirements.txt", "flask==2.0\n# c\nnumpy==1.1\n"), ("go.mod", "module m\nrequire (\n\tgithub.example/p/q v1.2.0\n)\n"), ("Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0"\n'), ("b/package.json", "{}"),
    ], "path string, content string")
    got = {(r.ecosystem, r.name, r.version) for r in S.manifest_deps(f).collect()}
    assert got == {("npm", "x", "^1.0"), ("pypi", "flask", "2.0"), ("pypi", "numpy", "1.1"), ("go", "github.example/p/q", "v1.2.0"), ("cargo", "serde", "1.0")}


def test_sections(spark):
    md = "# A\r\n## B\n```\n# no\n```\n### C\n## D ##\n# E\n#not\n"
    got = [tuple(r)[1:] for r in S.sections(spark.createDataFrame([("x.md", md), ("x.py", "# A"), ("y.md", None)], "file_path string, content string")).orderBy("line").collect()]
    assert got == [(1, 1, "A", None), (2, 2, "B", 1), (6, 3, "C", 2), (7, 2, "D", 1), (8, 1, "E", None)]


def test_folders(spark):
    got = {tuple(r) for r in S.folders(spark.createDataFrame([("a/b/c.py",), ("a/d.py",), (None,)], "path string")).collect()}
    assert got == {(".", "a"), ("a", "a/b"), ("a/b", "a/b/c.py"), ("a", "a/d.py")}


def test_store_replaces_and_upserts(spark, make, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/store")
    n = lambda *ids: make("nodes", [{"id": i, "kind": "File", "name": nm} for i, nm in ids])
    e = lambda *ids: make("edges", [{"id": i, "src": "a", "dst": "b", "type": "CALLS"} for i in ids])
    assert store.bulk_load(n(("a", "1"), ("b", "1")), e("1")) == {"nodes": 2, "edges": 1}
    assert store.bulk_load(n(("b", "2"), ("c", "2")), e("1", "2"), "upsert") == {"nodes": 3, "edges": 2}
    assert {r.id: r.name for r in store.read("nodes").collect()} == {"a": "1", "b": "2", "c": "2"}


def test_upsert_and_changed(spark):
    s = "k string, h string"
    old, new = spark.createDataFrame([("a", "1"), ("b", "1")], s), spark.createDataFrame([("b", "2"), ("a", "1")], s)
    assert {tuple(r) for r in upsert(old, new, ["k"]).collect()} == {("a", "1"), ("b", "2")}
    assert [tuple(r) for r in changed(new, old, ["k"], "h").collect()] == [("b", "2")]


def test_streams(spark, tmp_path):
    t = lambda h, m=0: datetime(2024, 1, 1, h, m)
    rows = [(1, t(0), 7, "view", 1.0, None), (1, t(0), 7, "view", 1.0, None), (2, t(0, 10), 7, "view", 2.0, None), (3, t(2), 8, "click", 3.0, None)]
    spark.createDataFrame(rows, EV.EVENT_DDL).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = EV.read_events(spark, str(tmp_path / "in"))
    EV.maintain_counts(EV.deduplicated(stream), str(tmp_path / "out"), str(tmp_path / "cp1")).awaitTermination(120)
    last = sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name[2:]))[-1]
    assert {tuple(r) for r in spark.read.parquet(str(last)).collect()} == {(7, 2), (8, 1)}
    q = EV.tumbling(EV.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.event_type, r.n, r.total) for r in spark.table("w").collect()} == {("view", 3, 4.0), ("click", 1, 3.0)}


def test_bounds_and_staging(spark):
    with pytest.raises(ValueError):
        small(spark.range(5), 4, "ids")
    assert len(small(spark.range(4), 4, "ids")) == 4
    st = Staging(spark, "test")
    df = st.cut(spark.range(3), "ids")
    assert df.count() == 3 and st.root.startswith(shared_dir(spark))
    st.clean()
    other = Staging(spark, "test")
    other.cut(spark.range(2), "ids")
    assert clean_staging(spark) >= 1 and not os.path.exists(other.root.removeprefix("file://"))
