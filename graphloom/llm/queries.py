"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["cleaning_queries", "source_queries", "secret_queries", "corpus_queries"]

QUERIES: dict = {}
SQL: dict = {}
for _m in MODULES:
    _part = import_module(f"graphloom.llm.{_m}")
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
