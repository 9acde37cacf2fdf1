"""Hierarchies and orphan references against brute force, with their edge cases."""

import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import hierarchy as H
from graphloom.operators import orphans as O


def brute(links):
    """(hierarchy, id) -> (root, depth) by walking up."""
    up, ids = {}, set()
    for h, c, p in links:
        ids |= {(h, c), (h, p)}
        up[(h, c)] = min(p, up.get((h, c), p))
    out = {}
    for h, i in ids:
        seen, at = [], i
        while at not in seen:
            seen.append(at)
            if (h, at) not in up:
                break
            at = up[(h, at)]
        if (h, seen[-1]) not in up:
            out[(h, i)] = (seen[-1], len(seen) - 1, list(reversed(seen)))
        else:
            ring = seen[seen.index(at):]
            out[(h, i)] = (min(ring), -1 if i in ring else -2, None)
    return out


def links_df(spark, rows):
    return spark.createDataFrame(rows, "hierarchy string, child string, parent string")


def random_links(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(1, n):
        shape = rng.random()
        parent = i - 1 if shape < 0.6 else rng.randrange(i)  # long chains and bushes
        if shape < 0.97:
            out.append(("containment", f"n{i}", f"n{parent}"))
    out += [("inheritance", "b", "c"), ("inheritance", "c", "d"), ("inheritance", "d", "b"), ("inheritance", "x", "b"), ("inheritance", "y", "x"), ("inheritance", "s", "s"), ("inheritance", "t", "s")]
    out += [("inheritance", f"z{i}", f"z{i + 1}") for i in range(9)] + [("inheritance", "z9", "z3")]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchies_match_a_walk(spark, seed):
    rows = random_links(seed, 120)
    got = H.hierarchies(links_df(spark, rows + rows[:10]), with_paths=True).collect()
    want = brute(rows)
    assert {(r.hierarchy, r.node_id): (r.root_id, r.depth, r.path) for r in got} == want
    assert len(got) == len(want)


def below(links):
    """(hierarchy, id, descendant, steps) by walking down."""
    up, kids = {}, {}
    for h, c, p in links:
        up[(h, c)] = min(p, up.get((h, c), p))
    for (h, c), p in up.items():
        kids.setdefault((h, p), []).append(c)
    out = set()
    for h, i in {(h, x) for h, c, p in links for x in (c, p)}:
        level, steps, seen = [i], 0, {i}
        while level:
            steps += 1
            level = [c for x in level for c in kids.get((h, x), []) if c not in seen]
            seen |= set(level)
            out |= {(h, i, c, steps) for c in level}
    return out


def test_descendants_and_cycles(spark):
    rows = [("containment", "b", "a"), ("containment", "c", "b"), ("containment", "d", "b"), ("containment", "p", "q"), ("containment", "q", "p"), ("containment", "r", "q"), ("containment", "s", "r")]
    df = links_df(spark, rows)
    got = {(r.node_id, r.descendant_id, r.distance) for r in H.descendants(df).collect()}
    assert got == {
        ("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1),
        ("p", "q", 1), ("q", "p", 1), ("q", "r", 1), ("p", "r", 2), ("r", "s", 1), ("q", "s", 2), ("p", "s", 3),
    }
    assert [tuple(r) for r in H.cycles(H.hierarchies(df)).collect()] == [("containment", "p", 2, 2)]


def test_descendants_match_a_walk(spark):
    rows = random_links(4, 60) + [("containment", "n1", "n59"), ("containment", "m", "k"), ("containment", "m", "j")]
    got = H.descendants(links_df(spark, rows + rows[:5])).collect()
    assert {tuple(r) for r in got} == below(rows) and len(got) == len(below(rows))
    assert {tuple(r) for r in H.dropped_links(links_df(spark, rows * 2)).collect()} == {(h, c, p) for h, c, p in rows if p > min(q for g, d, q in rows if (g, d) == (h, c))}
    assert H.descendants(links_df(spark, [])).count() == 0 and H.dropped_links(links_df(spark, [])).count() == 0


def test_hierarchy_edge_cases(spark, make):
    assert H.hierarchies(links_df(spark, [])).count() == 0
    rows = [("containment", None, "a"), ("containment", "a", None), (None, "a", "b"), ("containment", "", "é"), ("containment", "k", "m"), ("containment", "k", "l")]
    got = {(r.node_id, r.root_id, r.depth) for r in H.hierarchies(links_df(spark, rows)).collect()}
    # two parents: the smaller one counts, the other stays as a root of its own
    assert got == {("", "é", 1), ("é", "é", 0), ("k", "l", 1), ("l", "l", 0), ("m", "m", 0)}
    edges = make("edges", [
        {"id": "1", "src": "a", "dst": "b", "type": "DEFINES"}, {"id": "2", "src": "b", "dst": "a", "type": "EXTENDS"},
        {"id": "3", "src": "a", "dst": None, "type": "CONTAINS"}, {"id": "4", "src": "a", "dst": "z", "type": "CALLS"},
    ], extra="child string, parent string, k1 bigint")
    assert {tuple(r) for r in H.hierarchy_links(edges).collect()} == {("containment", "b", "a"), ("inheritance", "b", "a")}


T0 = datetime(2025, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


def test_orphans_by_cause(make):
    nodes = make("nodes", [
        {"id": "ok", "kind": "File", "indexed_at": day(0)},
        {"id": "late", "kind": "File", "indexed_at": day(10)},
        {"id": "gone", "kind": "File", "indexed_at": day(0), "removed_at": day(5)},
        # delivered twice: the earlier arrival counts, the removal of the richer row counts
        {"id": "twice", "kind": "File", "indexed_at": day(8)},
        {"id": "twice", "kind": "File", "name": "x", "indexed_at": day(1), "removed_at": day(20)},
        {"id": None, "kind": "File", "indexed_at": day(0)}, {"id": "timeless", "kind": "File"},
    ], extra="key string, born string")
    ext = make("id string, name string", [{"id": "ext"}, {"id": None}])
    e = lambda i, s, d, t: {"id": i, "src": s, "dst": d, "type": "CALLS", "indexed_at": None if t is None else day(t)}
    edges = make("edges", [
        e("1", "ok", "late", 9), e("2", "ok", "late", 10), e("3", "gone", "ok", 5), e("4", "gone", "ok", 4), e("5", "nope", "ext", 3), e("5", "nope", "ext", 3),
        e("6", "ok", None, 3), e("7", "twice", "OK", 2), e("8", "twice", "ok", 25), e("9", "timeless", "ok", 3), e("10", "nope", "ok", None), e("11", "late", "ok", None),
    ], extra="endpoint string, key string, cause string")
    got = {(r.edge_id, r.endpoint, r.cause) for r in O.orphan_references(edges, nodes, ext).collect()}
    assert got == {("1", "dst", "early"), ("3", "src", "removed"), ("5", "src", "missing"), ("7", "dst", "missing"), ("8", "src", "removed"), ("10", "src", "missing")}
    report = O.orphan_report(O.orphan_references(edges, nodes, ext)).collect()
    assert sum(r.n_orphans for r in report) == 6


def test_orphans_of_empty_tables(make):
    ext = make("id string", [])
    assert O.orphan_references(make("edges", []), make("nodes", []), ext).count() == 0
    edges = make("edges", [{"id": "1", "src": "a", "dst": "b", "type": "CALLS", "indexed_at": day(1)}])
    assert O.orphan_references(edges, make("nodes", []), ext).count() == 2


def test_orphans_with_many_external_symbols(make, monkeypatch):
    monkeypatch.setattr(O, "EXTERNAL_BOUND", 1)
    edges = make("edges", [{"id": "1", "src": "a", "dst": "b", "type": "CALLS", "indexed_at": day(1)}])
    got = O.orphan_references(edges, make("nodes", []), make("id string", [{"id": "a"}, {"id": "c"}])).collect()
    assert [(r.edge_id, r.endpoint) for r in got] == [("1", "dst")]
