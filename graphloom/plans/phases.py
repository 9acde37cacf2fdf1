"""The phases of an analysis as functions over tables, put in order and composed."""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import analytics as N
from graphloom.operators import flows as W
from graphloom.operators.graph_tables import merge_edges, merge_nodes
from graphloom.runtime import Staging

Tables = dict[str, DataFrame]


def ordered(deps: dict[str, list[str]]) -> list[str]:
    """Phases so that each follows what it needs; of those that are ready the smallest name goes first.

    A need that is no phase, or a cycle, is an error that names its phases.
    """
    for p, needs in deps.items():
        missing = [n for n in needs if n not in deps]
        if missing:
            raise ValueError(f"{p} needs {', '.join(missing)}, which is no phase")
        if len(set(needs)) != len(needs):
            raise ValueError(f"{p} names a need twice")
    left = {p: len(needs) for p, needs in deps.items()}
    users: dict[str, list[str]] = {p: [] for p in deps}
    for p, needs in deps.items():
        for n in needs:
            users[n].append(p)
    ready = sorted(p for p, n in left.items() if not n)
    out = []
    while ready:
        p = heapq.heappop(ready)
        out.append(p)
        for u in users[p]:
            left[u] -= 1
            if not left[u]:
                heapq.heappush(ready, u)
    if len(out) < len(deps):
        raise ValueError("a cycle holds " + ", ".join(sorted(set(deps) - set(out))))
    return out


# The phases of a full analysis and what each needs.
DEPENDENCIES = {
    "scan": [], "profile": ["scan", "parse"], "repo-node": ["profile"], "structure": ["scan"], "coverage": ["scan", "profile", "structure"], "markdown": ["structure"], "parse": ["scan", "structure"],
    "incremental-scope": ["scan"], "complexity": ["parse", "scan"], "business-logic": ["parse", "scan"], "routes": ["parse", "profile"], "openapi": ["routes", "profile"], "tools": ["parse"], "orm": ["parse"],
    "cross-file": ["parse", "routes", "tools", "orm", "incremental-scope"], "accesses": ["parse", "cross-file"], "scip-index": ["scan", "profile", "parse", "cross-file", "accesses"], "confidence-demote": ["scip-index"],
    "mro": ["cross-file", "structure", "incremental-scope"], "communities": ["mro", "structure", "incremental-scope"], "dead-code": ["cross-file", "mro", "communities"],
    "processes": ["communities", "routes", "tools", "structure", "incremental-scope"], "fetches": ["parse", "profile", "routes"], "temporal": ["scan"], "cochange": ["temporal"],
    "ownership": ["scan", "parse", "temporal", "communities"], "dependencies": ["scan", "profile"], "sbom": ["dependencies"], "annotate": ["processes", "temporal", "cochange"], "risk-snapshot": ["annotate"],
    "embeddings": ["annotate", "communities", "confidence-demote"],
}


class Analysis:
    """Runs registered phases in order; each takes the tables so far and adds its own, which are written once."""

    def __init__(self) -> None:
        self.phases: dict[str, tuple[list[str], Callable[[Tables], Tables]]] = {}

    def phase(self, name: str, needs: list[str]):
        def add(f: Callable[[Tables], Tables]):
            self.phases[name] = (needs, f)
            return f

        return add

    def run(self, tables: Tables, only: set[str] | None = None) -> Tables:
        """All phases, or those of ``only`` with what they need."""
        deps = {p: needs for p, (needs, _) in self.phases.items()}
        wanted = set(deps) if only is None else set()
        todo = list(only or ())
        while todo:
            p = todo.pop()
            if p not in wanted:
                wanted.add(p)
                todo += deps[p]
        have = dict(tables)
        for name in ordered(deps):
            if name in wanted:
                for k, df in self.phases[name][1](have).items():
                    have[k] = Staging(df.sparkSession, f"phase-{name}").cut(df, k)
        return have


ANALYSIS = Analysis()


@ANALYSIS.phase("merge", [])
def _(t: Tables) -> Tables:
    return {"nodes": merge_nodes(t["raw_nodes"], [c for c in t["raw_nodes"].columns if c != "content"]), "edges": merge_edges(t["raw_edges"])}


@ANALYSIS.phase("confidence-demote", ["merge"])
def _(t: Tables) -> Tables:
    d = N.demote(t["edges"])
    return {"edges": t["edges"].drop("confidence", "reason").join(d, "id")}


@ANALYSIS.phase("communities", ["confidence-demote"])
def _(t: Tables) -> Tables:
    return {"communities": N.communities(t["edges"])}


@ANALYSIS.phase("dead-code", ["communities"])
def _(t: Tables) -> Tables:
    dead = N.dead_code(t["nodes"], t["edges"])
    return {"deadness": dead, "ghosts": N.ghosts(t["communities"].select("id", "community"), dead, "community")}


@ANALYSIS.phase("processes", ["communities"])
def _(t: Tables) -> Tables:
    steps = W.call_steps(t["nodes"], t["edges"])
    walked = W.flows(W.entries(t["nodes"], steps), steps)
    return {"processes": W.processes(t["nodes"], walked), "process_steps": W.step_edges(walked)}


@ANALYSIS.phase("annotate", ["processes", "dead-code"])
def _(t: Tables) -> Tables:
    by = lambda what, df, c: A.count_by(df, c).select(F.lit(what).alias("what"), F.col(c).alias("name"), "n")
    return {"stats": by("node", t["nodes"], "kind").unionByName(by("edge", t["edges"], "type")).unionByName(by("deadness", t["deadness"], "deadness"))}
