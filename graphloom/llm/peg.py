"""A small packrat parser for parsing-expression grammars, with semantic actions and source offsets.

Expressions are functions ``(run, pos) -> (end, value) | None``.  Rules are memoised per position, so
each is tried at most once at each offset of a text and parsing takes linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

Result = tuple[int, Any] | None
Expr = Callable[["Run", int], Result]


class Run:
    """One parse of one text: the memo table and the text."""

    __slots__ = ("memo", "text")

    def __init__(self, text: str) -> None:
        self.text = text
        self.memo: dict[tuple[int, int], Result] = {}


def term(pattern: str, flags: int = 0) -> Expr:
    """A terminal; its value is the match object."""
    match = re.compile(pattern, flags).match

    def expr(run: Run, pos: int) -> Result:
        m = match(run.text, pos)
        return (m.end(), m) if m else None

    return expr


def seq(*parts: Expr) -> Expr:
    def expr(run: Run, pos: int) -> Result:
        out = []
        for p in parts:
            r = p(run, pos)
            if r is None:
                return None
            pos = r[0]
            out.append(r[1])
        return pos, out

    return expr


def first(*parts: Expr) -> Expr:
    """Ordered choice."""

    def expr(run: Run, pos: int) -> Result:
        for p in parts:
            r = p(run, pos)
            if r is not None:
                return r
        return None

    return expr


def many(part: Expr, least: int = 0) -> Expr:
    def expr(run: Run, pos: int) -> Result:
        out = []
        while True:
            r = part(run, pos)
            if r is None or r[0] == pos:
                break
            pos = r[0]
            out.append(r[1])
        return (pos, out) if len(out) >= least else None

    return expr


def maybe(part: Expr) -> Expr:
    def expr(run: Run, pos: int) -> Result:
        return part(run, pos) or (pos, None)

    return expr


def action(part: Expr, f: Callable[[str, int, int, Any], Any]) -> Expr:
    """``f(text, start, end, value)`` replaces the value."""

    def expr(run: Run, pos: int) -> Result:
        r = part(run, pos)
        return None if r is None else (r[0], f(run.text, pos, r[0], r[1]))

    return expr


def cut(part: Expr) -> Expr:
    """A part whose success is final: nothing before its end is tried again, so its memos are let go."""

    def expr(run: Run, pos: int) -> Result:
        r = part(run, pos)
        if r is not None and r[0] > pos:
            run.memo.clear()
        return r

    return expr


class Rule:
    """A memoised nonterminal; define it after use with :meth:`set`, which allows recursion."""

    _next = 0

    def __init__(self) -> None:
        Rule._next += 1
        self.key = Rule._next
        self.expr: Expr | None = None

    def set(self, expr: Expr) -> Rule:
        self.expr = expr
        return self

    def __call__(self, run: Run, pos: int) -> Result:
        k = (self.key, pos)
        if k in run.memo:
            return run.memo[k]
        run.memo[k] = r = self.expr(run, pos)
        return r
