"""Problems 1 and 9: files not written by hand, residue texts."""

import pytest

from graphloom.llm import handwritten as H
from graphloom.llm import residue as R


@pytest.mark.parametrize("path, content, want", [
    ("a/b/src/x.py", "# Code generated by gramkit v1.2.3. DO NOT EDIT.\nclass A:\n    pass\n", "generated"),
    ("a/b/src/x.ts", "// Diese Datei wurde von apimill 1.0.0 automatisch erzeugt. Bitte nicht bearbeiten.\nexport const a = 1;\n", "generated"),
    ("a/b/src/x.ts", "export const a = 1;\n// end of client: emitted by gramkit from openapi.yaml, sha 12ab34\n", "generated"),
    ("a/b/src/x.ts", "/*\n * wirec 2.10.11 wrote this module from a.idl on build.\n */\nexport const a = 1;\n", "generated"),
    ("a/b/src/x.ts", "// This was once generated by stubforge; since the rewrite it is maintained by hand, edit freely.\nexport const a = 1;\n", None),
    ("a/b/src/x.ts", "// Not generated. Keep the field order in step with the schema.\nexport const a = 1;\n", None),
    ("a/b/src/x.py", "# Helpers that find @generated files and skip them during review.\nimport re\n", None),
    ("a/b/src/x.py", "# Do not edit files in gen/ by hand; this script rebuilds them.\nimport re\n", None),
    ("a/b/src/x.py", "# Replaces the vendored slatecsv copy; everything below was written for this package.\nimport re\n", None),
    ("a/b/src/x.py", "# Copied verbatim from slatecsv 3.1.5 (upstream tag).\nimport re\n", "copied"),
    ("a/b/src/x.py", "# Copyright (C) 2025 the maintainers of this repository.\nimport re\n", None),
    ("a/b/src/x.py", "# larkmetrics 3.10.4 -- Copyright (C) 2011 larkmetrics project.\n# SPDX-License-Identifier: Zlib\nimport re\n", "copied"),
    ("a/b/vendor/larkmetrics/x.go", "package x\n", "vendored"),
    ("a/b/src/vendor/x.go", "package x\n", None),
    ("a/b/vendor_portal/x.go", "package x\n", None),
    ("a/b/package-lock.json", "{}", "lockfile"),
    ("a/b/static/x.min.js", "var a", "suffix"),
    ("a/b/src/x.js", "function y(t,w){return t?w.stock(t):void 0}" * 40, "minified"),
    ("a/b/src/x.py", 'SELECT = "' + "SELECT a, b " * 200 + '"\n' + "def f():\n    return SELECT\n" * 3, None),
    ("a/b/src/x.rs", "pub static T: &[u8] = &[\n" + "\t0x8c, 0xcf, 0xa2, 0xab, 0xe4, 0x61, 0x9c,\n" * 30 + "];\n", "data"),
    # a notice counts wherever it stands in the opening comments, however long they and the file are
    ("a/b/src/x.go", "// licence text\n" * 300 + "// Code generated by protoc-gen-x. DO NOT EDIT.\npackage x\n" + "var a = f()\n" * 20, "generated"),
    ("a/b/src/x.go", "// licence text\n" * 300 + "// Code generated by protoc-gen-x. DO NOT EDIT.\npackage x\n" + "var a = f()\n" * 900, "generated"),
    ("a/b/src/x.ts", "import a from 'a';\n// Code generated by gramkit. DO NOT EDIT.\nexport const b = a;\n", "generated"),
    ("a/b/src/x.py", '"""\nOutput of modelpress 3.5.3, rebuilt by every release.\n"""\nA = 1\n', "generated"),
    ("a/b/src/x.ts", "export const a = 1;\n// @generated code is skipped below\nconst b = 2;\n// Code generated by x\nf();\n", None),
    ("a/b/src/x.ts", "f();\n" + "// end\n" * 9 + "// Generated by gramkit 1.0\n" + "// end\n" * 9, "generated"),
    ("a/b/src/x.rs", "static T: [u8; 3] = [\n1, 2, 3, 4, 5, 6, 7,\n1, 2, 3, 4, 5, 6, 7,\n1, 2, 3, 4, 5, 6, 7,\n];\n", "data"),
    (None, "", None),
])
def test_reasons(path, content, want):
    assert H.reason(path, content, H._automaton()) == want


def test_files_edge_cases(make):
    nodes = make("nodes", [
        {"id": "1", "kind": "File", "file_path": "a/b/yarn.lock", "content": "x"},
        {"id": "1", "kind": "File", "file_path": "a/b/yarn.lock", "content": "x"},
        {"id": "2", "kind": "File", "file_path": None, "content": "// @generated by x 1.0\n"},
        {"id": "3", "kind": "File", "file_path": "a/b/yarn.lock"}, {"id": None, "kind": "File", "file_path": "a/b/yarn.lock", "content": "x"},
        {"id": "4", "kind": "File", "file_path": "a/b/c.py", "content": ""}, {"id": "5", "kind": None, "file_path": "a/b/yarn.lock", "content": "x"},
        {"id": "6", "kind": "File", "file_path": "a/b/c.py", "content": "x = 1\n" * 200_000},
        # the delivery with more fields decides
        {"id": "7", "kind": "File", "file_path": "a/b/yarn.lock", "content": "x"},
        {"id": "7", "kind": "File", "file_path": "a/b/c.py", "content": "x = 1\n", "language": "python", "name": "c.py"},
    ], extra="reason string, rank int, n int, has boolean")
    assert sorted(r.node_id for r in H.not_handwritten(nodes).collect()) == ["1", "2"]
    assert {r.node_id: r.reason for r in H.classify_files(nodes).collect()} == {"1": "lockfile", "2": "generated", "4": None, "6": None, "7": None}
    assert H.not_handwritten(make("nodes", [])).count() == 0


RESIDUE = [
    "# {{ cookiecutter.name }}\n\nThe {{ module }} package of {{ team }} handles {{ purpose }}.",
    "404 Not Found\n\nThe requested path /a was not found on this server.",
    "Please enable JavaScript to view the board.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Access denied. You do not have permission to view this page.",
    "None nodes in `None` carry no line range, so the None view skips them.",
    "asdf qwer\nasdf qwer\nasdf qwer",
    "Cette page a été déplacée ou supprimée. Référence 5c73ea4e",
]
REAL = [
    "The client returns 404 Not Found when the record has been removed, and 503 while the cache is rebuilt.",
    "Strings like ${route.date} are expanded at load time, undefined names raise an error.",
    "Test fixtures use lorem ipsum dolor sit amet as filler so that no customer text ends up in the repository.",
    "Sign-in is required for the mount space since 2.4.11; ask the blocks group for a seat.",
    "Renaming `pollCabin` touched 12 callers.",
    "The dashboard shows \"Please enable JavaScript\" when scripts are off; the text lives in `messages`.",
]


def test_residue(spark):
    rows = [(i, t, None, None) for i, t in enumerate(RESIDUE)] + [(100 + i, t, "T", "code.example/x") for i, t in enumerate(REAL)]
    rows += [(200, None, None, None), (201, "", None, None), (202, "  \n", "x", None), (203, "We measured 5 ms for the new path. " * 30_000, None, None)]
    docs = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, title string, repo_uri string, bad int")
    assert sorted(r.doc_id for r in R.residue(docs).collect()) == list(range(len(RESIDUE)))
    assert R.residue(docs.limit(0)).count() == 0


def test_doubtful_notice_needs_evidence(spark):
    docs = spark.createDataFrame([(1, "Sorry! The north wing pump drains slowly today", "North wing pump", None)], "doc_id long, text string, title string, repo_uri string")
    assert R.residue(docs).count() == 0


def evidence(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string, repo_uri string")
    return {r.doc_id: (r.evidence, r.n_hosts) for r in R.residue_evidence(docs).collect()}


def test_wording_that_no_list_holds(spark):
    # one answer under many addresses of several hosts, and nowhere among other sentences
    strange = "Whoopsie-daisy, the gnomes mislaid your parchment once more."
    rows = [(i, strange, f"Guide to {w} pumps", f"code.example/h{i % 3}/{w}") for i, w in enumerate(["bronze", "copper", "silver", "golden"])]
    # the same shape, but the sentence also stands in pages that say more, or answers its title, or comes from one host
    common = "The cache gets rebuilt after every nightly run."
    rows += [(10 + i, common, f"Notes on {w}", f"code.example/h{i % 3}/{w}") for i, w in enumerate(["anchors", "ropes", "sails", "masts"])]
    rows += [(20, f"{common} Ropes are checked by hand. Sails follow a week later. Masts are left alone.", "Deck work", "code.example/h1/deck")]
    rows += [(30 + i, "Bronze bolts outlast copper ones at sea.", f"Bronze in {w}", f"code.example/h{i}/{w}") for i, w in enumerate(["summer", "winter", "autumn", "spring"])]
    rows += [(40 + i, "Nobody waters these plants any longer.", f"Page {w}", "code.example/h1/same") for i, w in enumerate(["summer", "winter", "autumn", "spring"])]
    got = evidence(spark, rows)
    assert {d for d, (e, _) in got.items() if e} == {0, 1, 2, 3}
    assert got[0] == ("served", 4)


def test_notices_by_host_and_term_evidence(spark):
    # the notice outweighs what is said; it is residue unless it answers its address and only one host serves it
    text = "The mooring guide could not be loaded. Mooring lines wear early."
    one = evidence(spark, [(1, text, "Mooring lines", "code.example/a/x")])
    many = evidence(spark, [(1, text, "Mooring lines", "code.example/a/x"), (2, "The list could not be loaded.", None, "code.example/b/y")])
    assert one[1][0] is None and many[1] == ("response", 2) and many[2] == ("response", 2)


@pytest.mark.parametrize("text, want", [
    ("The @phase@ phase emits one @relation@ edge per @kind@.", True),
    ("# TODO(ward.date)\n\nSee TODO(fleet.text) and TODO(toll.summary).", True),
    ("# __slot date__\n\n__lens owner__ keeps __shift name__.", True),
    ("___ nodes in ___ carry no range, so the ___ view skips them.", True),
    ("Mail a@b.example, c@d.example and e@f.example about the quarter results, please, today.", False),
    ("Two routes share /a/{id}, /b/{id} and /c/{id}; the first wins.", False),
    ("See [one](a), [two](b) and [three](c).", False),
    ("Placeholders in angle brackets, such as <owner> or <date>, stand for values you choose.", False),
    ("blah blah. blah blah. blah blah", True),
])
def test_slots_in_any_marks(text, want):
    assert R.profile(text, None, None)[2] is want
