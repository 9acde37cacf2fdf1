"""Ignore files, blame, coverage, lockfiles, specifications, legacy sources, contracts, sinks, phases and guards."""

import json

import pytest

from graphloom.functions import sql_guard as G
from graphloom.operators import contracts as K
from graphloom.operators import indexer as I
from graphloom.operators import retrieval as R
from graphloom.plans.phases import DEPENDENCIES, ordered
from graphloom.sources import ignore as IG
from graphloom.sources import reports as P
from graphloom.sources import sinks as SK


def texts(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "text string")


@pytest.mark.parametrize("rules, path, want", [
    ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("build/", "build/x.js", True), ("build/", "src/build", False), ("/top", "top/x", True), ("/top", "a/top/x", False),
    ("a/*.c", "a/x.c", True), ("a/*.c", "b/a/x.c", False), ("**/x/*.c", "b/x/y.c", True), ("x/**", "x/y/z", True), ("# c\n\n", "a", False), ("out/\n!out/keep", "out/keep", True), ("f?o", "fao", True), ("*.{a}", "x.{a}", True),
])
def test_ignore_rules(rules, path, want):
    assert IG.ignored(path, IG.rules_of("", rules)) is want


def test_nested_ignore_files(spark):
    files = spark.createDataFrame([("a.tmp",), ("sub/a.tmp",), ("sub/b.txt",), ("other/b.txt",), (None,)], "path string")
    got = IG.without_ignored(files, [("sub", "!a.tmp\nb.txt"), ("", "*.tmp")]).collect()
    assert {r.path for r in got} == {"sub/a.tmp", "other/b.txt", None}


def test_blame(spark):
    t = "abcdef1 1 1 2\nauthor Ann\nauthor-mail <A@x.example>\nsummary s\n\tone\nabcdef1 2 2\n\ttwo\nabcdef2 9 3 1\nauthor Bob\n\tno address\nabcdef1 7 4\n\tauthor of nothing\n"
    got = sorted(tuple(r) for r in P.blame(spark.createDataFrame([("f.py", t), ("e.py", ""), ("n.py", None)], "file_path string, text string")).collect())
    assert got == [("f.py", n, "abcdef1", "a@x.example", "Ann") for n in (1, 2, 4)]


def test_coverage_forms(spark):
    cob = '<?xml version="1.0"?><!DOCTYPE coverage SYSTEM "x.dtd"><coverage><packages><package><classes><class filename="a.py"><lines><line number="1" hits="2"/><line number="2" hits="0"/></lines></class></classes></package></packages></coverage>'
    jac = '<report name="r"><package name="p/q"><sourcefile name="A.java"><line nr="3" mi="0" ci="4"/><line nr="4" mi="2" ci="0"/></sourcefile></package></report>'
    js = json.dumps({"files": {"b.py": {"executed_lines": [1, 2], "missing_lines": [3]}, "c.py": {"executed_lines": [], "missing_lines": []}}})
    row = lambda df: [(r.file, r.total, r.covered, list(r.covered_lines)) for r in df.collect()]
    assert row(P.cobertura(texts(spark, cob, "<coverage/>", None))) == [("a.py", 2, 1, [1])]
    assert row(P.jacoco(texts(spark, jac))) == [("p/q/A.java", 2, 1, [3])]
    assert row(P.coverage_json(texts(spark, js, "{}", "no json"))) == [("b.py", 3, 2, [1, 2])]


def test_lockfiles(spark):
    f = spark.createDataFrame([
        ("a/package.json", json.dumps({"dependencies": {"x": "^1"}, "devDependencies": {"x": "^1", "y": "2"}})), ("a/package-lock.json", json.dumps({"packages": {"": {}, "node_modules/x": {"version": "1.2.0"}, "node_modules/x/node_modules/@s/z": {"version": "3.0.0"}}})),
        ("b/package.json", json.dumps({"devDependencies": {"d": "1"}})), ("c/yarn.lock", '# c\n"@a/b@^1.0", "@a/b@^1.1":\n  version "1.1.5"\nq@^2:\n  version "2.0.1"\n'), ("d/pnpm-lock.yaml", "packages:\n\n  '@t/u@4.0.0':\n    x: 1\n  v@5.1.0(w@1):\n    y: 1\n"),
        ("e/pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>m</artifactId><version>7</version></dependency></dependencies></project>"), ("f/x.csproj", '<Project><ItemGroup><PackageReference Include="N.Pkg" Version="6.0" /></ItemGroup></Project>'),
        ("g/package-lock.json", json.dumps({"dependencies": {"old": {"version": "0.1"}}})), ("h/pom.xml", ""), ("i/package-lock.json", None),
    ], "path string, content string")
    got = {(r.path[0], r.ecosystem, r.name, r.version) for r in P.dependencies(f).collect()}
    assert got == {
        ("a", "npm", "x", "1.2.0"), ("a", "npm", "@s/z", "3.0.0"), ("b", "npm", "d", "1"), ("c", "npm", "@a/b", "1.1.5"), ("c", "npm", "q", "2.0.1"), ("d", "npm", "@t/u", "4.0.0"), ("d", "npm", "v", "5.1.0"),
        ("e", "maven", "g:m", "7"), ("f", "nuget", "N.Pkg", "6.0"), ("g", "npm", "old", "0.1"),
    }


def test_openapi(spark):
    spec = json.dumps({"paths": {"/a/:id": {"get": {"operationId": "g", "summary": "s"}, "parameters": []}, "/b": {"POST": {}}}})
    got = {tuple(r) for r in P.openapi(spark.createDataFrame([("x.json", spec), ("y.json", "no")], "file_path string, content string")).collect()}
    assert got == {("x.json", "GET", "/a/{id}", "g", "s"), ("x.json", "POST", "/b", None, None)}


def test_cobol(spark):
    src = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. Payroll.\n      * COPY NOTHIS.\n       COPY DATES.\n       MAIN SECTION.\n       DO-WORK.\n           PERFORM X.\n"
    got = {(r.what, r.name, r.type) for r in P.cobol(spark.createDataFrame([("p.cbl", src), ("p.py", src)], "file_path string, content string")).collect()}
    assert got == {("program", "PAYROLL", "DEFINES"), ("section", "MAIN", "DEFINES"), ("paragraph", "DO-WORK", "DEFINES"), ("copybook", "DATES", "IMPORTS")}


def test_frameworks(spark):
    deps = spark.createDataFrame([("r", "npm", "react"), ("r", "npm", "x")], "repo_uri string, ecosystem string, name string")
    paths = spark.createDataFrame([("r", "a/app.ts"), ("q", "a/app.ts"), ("q", "Dockerfile")], "repo_uri string, path string")
    rules = [("react", "npm", "manifest", "react"), ("ts", "npm", "file", r"\.ts$"), ("docker", "*", "file", "^Dockerfile$")]
    got = {r.repo_uri + ":" + r.framework: list(r.evidence) for r in P.frameworks(rules, deps, paths).collect()}
    assert got == {"r:react": ["manifest:react"], "r:ts": ["file:a/app.ts"], "q:docker": ["file:Dockerfile"]}


def test_contracts_from_source(spark):
    js = "app.get('/u/:id/', h);\nx\nfetch('/u/{id}?q=1', { method: 'POST' });\naxios.delete(`/v`)\nconsumer.subscribe({ topic: 'arn:aws:sns:r:1:t' })\n"
    py = "@app.route('/w', methods=['GET', 'put'])\ndef f(): pass\nrequests.patch('http://h/x')\nproducer.send('t')\n"
    files = spark.createDataFrame([("a.ts", "r1", js), ("b.py", "r2", py), ("c.proto", "r1", "\nservice Greeter {}"), ("d.ts", "r1", None), ("e.md", "r1", js)], "file_path string, repo_uri string, content string")
    got = {(r.type, r.signature, r.file_path, r.line) for r in K.extract(files).collect()}
    assert {g for g in got if g[2] == "b.py"} == {("http_route", "GET /w", "b.py", 1), ("http_route", "PUT /w", "b.py", 1), ("http_call", "PATCH /http://h/x", "b.py", 3), ("topic_producer", "t", "b.py", 4)}
    assert {("http_route", "GET /u/{id}", "a.ts", 1), ("http_call", "POST /u/{id}", "a.ts", 3), ("http_call", "DELETE /v", "a.ts", 4), ("topic_consumer", "t", "a.ts", 5)} <= got
    assert ("grpc_service", "Greeter", "c.proto", 2) in got and not {g for g in got if g[2] == "e.md"}


def test_contract_links(spark):
    c = spark.createDataFrame([
        ("http_route", "GET /a", "p", "p.ts", 1), ("http_call", "GET /a", "q", "q.ts", 2), ("http_call", "GET /a", "p", "own.ts", 3), ("http_call", "GET /ab", "q", "q.ts", 4), ("grpc_service", "x.v1.Greeter/Hi", "p", "g.proto", 5),
        ("grpc_client", "Greeter", "q", "c.ts", 6), ("grpc_client", "Greet", "q", "c.ts", 7), ("topic_producer", "Greeter", "p", "t.ts", 8), ("topic_producer", "orders-v1", "p", "t.ts", 9), ("topic_consumer", "orders-v2", "q", "s.ts", 10),
    ], "type string, signature string, repo_uri string, file_path string, line int")
    m = spark.createDataFrame([("topic", "p", "q", "orders"), ("grpc", "p", "q", "Greeter")], "family string, producer_repo string, consumer_repo string, contract string")
    got = {(r.p_line, r.c_line, r.reason) for r in K.cross_links(c, m).collect()}
    assert got == {(1, 2, "signature"), (5, 6, "signature"), (9, 10, "manifest")}
    assert K.cross_links(c.limit(0)).count() == 0


def test_ranges_and_derived_edges(spark):
    rng = "start_line int, start_char int, end_line int, end_char int"
    defs = spark.createDataFrame([("C#", "f", 0, 0, 90, 1), ("m().", "f", 10, 2, 20, 3), ("n().", "f", 15, 0, 15, 40), ("o().", "f", 15, 0, 15, 20)], f"symbol string, file_path string, {rng}")
    occ = spark.createDataFrame([
        (1, "f", 15, 5, 15, 9, "x().", "reference"), (2, "f", 15, 25, 15, 30, "y#", "reference"), (3, "f", 12, 0, 12, 5, "m().", "reference"), (4, "f", 12, 0, 12, 5, "z().", "import"),
        (5, "f", 12, 0, 12, 5, "local 3", "reference"), (6, "f", 80, 0, 80, 5, "x().", "reference"), (7, "f", 10, 0, 10, 1, "x().", "reference"), (8, "g", 1, 0, 1, 1, "x().", "reference"),
    ], f"site_id int, file_path string, {rng}, symbol string, role string")
    assert {tuple(r) for r in I.derived_edges(occ, defs).collect()} == {("o().", "x().", "CALLS"), ("n().", "y#", "REFERENCES")}
    assert {tuple(r) for r in I.enclosing(occ.drop("symbol"), defs).collect()} == {(1, "o()."), (2, "n()."), (3, "m()."), (4, "m()."), (5, "m()."), (6, "C#"), (7, "C#")}


def test_cache_and_pack(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2025, 1, 1)
    e = spark.createDataFrame([(i, 10, t0 + timedelta(minutes=17 * i)) for i in range(20)] + [(99, None, t0)], "key int, bytes long, mtime timestamp")
    assert {r.key for r in SK.kept_in_cache(e, 100).collect()} == set(range(11, 20))
    assert SK.kept_in_cache(e, 1000).count() == 20
    one = SK.write_pack({"a": spark.range(5), "b": spark.range(0)}, f"file://{tmp_path}/p1").collect()
    two = SK.write_pack({"a": spark.range(4, -1, -1).repartition(3), "b": spark.range(0)}, f"file://{tmp_path}/p2").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and one[0].n_rows == 5 and one[0].digest != one[1].digest


def test_phases_in_order():
    assert ordered({"b": ["a"], "a": [], "c": ["a"], "0": ["c"]}) == ["a", "b", "c", "0"]
    for bad in ({"a": ["b"], "b": ["a"], "c": []}, {"a": ["x"]}, {"a": ["b", "b"], "b": []}):
        with pytest.raises(ValueError):
            ordered(bad)
    at = {p: i for i, p in enumerate(ordered(DEPENDENCIES))}
    assert len(at) == 31 and all(at[n] < at[p] for p, needs in DEPENDENCIES.items() for n in needs)


@pytest.mark.parametrize("text, ok", [
    ("MATCH (n) RETURN n.created", True), ("OPTIONAL MATCH (n) WHERE n.set = 'CREATE' RETURN n", True), ("CALL QUERY_FTS_INDEX('a', 'b') RETURN node", True), ("MATCH (n) DELETE n", False), ("CALL db.drop()", False),
    ("CREATE (n)", False), ("MATCH (n) RETURN n; MATCH (m) RETURN m", False), ("", False), ("match (n) // x\nset n.a = 1", False),
])
def test_pattern_guard(text, ok):
    if ok:
        assert G.check_pattern(text)
    else:
        with pytest.raises(G.NotReadOnly):
            G.check_pattern(text)


def test_rendered_rows(spark):
    rows, more = G.rendered(spark.range(3).selectExpr("id", "9007199254740993 as big", "true as t"), 2)
    assert rows == [{"id": 0, "big": "9007199254740993", "t": True}, {"id": 1, "big": "9007199254740993", "t": True}] and more


def test_search_text_and_models():
    assert R.search_text("q", "c", " g ") == "c — g — q" and R.search_text("q", None, "") == "q"
    assert R.compatible(None, "m", None, 4)[0] and R.compatible("m", "m", 4, 4)[0]
    assert not R.compatible("m", "n", 4, 4)[0] and not R.compatible("m", "m", 4, 8)[0] and not R.compatible("m", None, 4, None)[0]


def test_embedding_chunks(spark, make):
    n = make("nodes", [{"id": "a", "kind": "Class", "signature": "s", "description": "x\n" * 1500}, {"id": "b", "kind": "Class"}, {"id": "c", "kind": "File", "signature": "s"}, {"id": "d", "kind": "Method", "description": "y" * 2500}])
    got = R.embedding_chunks(n).orderBy("node_id", "chunk_index").collect()
    assert [(r.node_id, r.chunk_index) for r in got] == [("a", 0), ("a", 1), ("d", 0)] and all(len(r.text) <= 2000 for r in got if r.node_id == "a")
    assert "\n".join(r.text for r in got if r.node_id == "a") == "s\n" + "x\n" * 1500
    known = R.embedding_chunks(n).where("not (node_id = 'a' and chunk_index = 1)")
    assert {r.node_id for r in R.embedding_chunks(n, known).collect()} == {"a"}
