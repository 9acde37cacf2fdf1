"""Ignore files of a repository: patterns, negation, anchoring, and nesting by folder."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import glob_regex


@dataclass(frozen=True)
class Rule:
    """One pattern of the ignore file in ``base``."""

    base: str
    negated: bool
    folders_only: bool
    regex: re.Pattern


def rules_of(base: str, content: str) -> list[Rule]:
    """The rules of one ignore file, in order.  A pattern with a slash before its end counts from ``base``, others at any depth."""
    out = []
    for raw in content.splitlines():
        pat = raw.rstrip()
        if not pat or pat.startswith("#"):
            continue
        negated = pat.startswith("!")
        pat = pat[negated:]
        only = pat.endswith("/")
        pat = pat.rstrip("/") if only else pat
        anchored = "/" in pat
        pat = pat.removeprefix("/")
        if pat:
            body = glob_regex(pat, braces=False)[1:-1]
            out.append(Rule(base.strip("/"), negated, only, re.compile(f"^{'' if anchored else '(?:.*/)?'}{body}$")))
    return out


def ignored(path: str, rules: list[Rule]) -> bool:
    """Whether a file's path is ignored.  The last rule that fits decides; below an ignored folder nothing is brought back."""
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at, folder, out = "/".join(parts[:n]), n < len(parts), False
        for r in rules:
            if r.base and not at.startswith(r.base + "/"):
                continue
            if (folder or not r.folders_only) and r.regex.match(at[len(r.base) + 1:] if r.base else at):
                out = not r.negated
        if out:
            return True
    return False


def without_ignored(files: DataFrame, ignore_files: list[tuple[str, str]], path: str = "path") -> DataFrame:
    """Files that no rule of ``(folder, content)`` ignores; outer folders first, so inner rules have the last word."""
    rules = [r for base, text in sorted(ignore_files, key=lambda x: (x[0].count("/") + bool(x[0].strip("/")), x[0])) for r in rules_of(base, text)]

    @F.pandas_udf("boolean")
    def hit(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: isinstance(p, str) and ignored(p, rules))

    return files.where(~hit(F.col(path)))
