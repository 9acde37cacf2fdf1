"""All registered queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["pipeline_queries", "graph_queries", "history_queries", "relation_queries", "decision_queries", "flow_queries", "catalogue_queries", "source_queries"]


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        part = getattr(import_module(f"graphloom.plans.{m}"), name)
        clash = out.keys() & part.keys()
        assert not clash, clash
        out |= part
    return out


def queries() -> dict:
    return _all("QUERIES")


def sql() -> dict:
    return _all("SQL")
