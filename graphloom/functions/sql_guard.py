"""A read-only gate for SQL texts, and guarded execution over registered tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# First words that are allowed, and words that are banned anywhere.
ALLOWED = frozenset("select with explain describe show values from table".split())
BANNED = frozenset(
    "insert update delete drop create alter truncate merge replace grant revoke load cache uncache refresh analyze msck repair export import install attach detach pragma copy vacuum call set reset use add "
    "reflect java_method".split()
)
_STRIP = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_FILE = re.compile(r"\b(?:parquet|csv|json|text|orc|avro|binaryfile|delta)\s*\.\s*`", re.I)


class NotReadOnly(ValueError):
    """The statement may write, or reads something that is not registered."""


def check(sql: str) -> str:
    if _FILE.search(sql):
        raise NotReadOnly("reading files by path is not allowed")
    bare = _STRIP.sub(" ", sql).strip().rstrip(";").strip()
    if not bare:
        raise NotReadOnly("empty statement")
    if ";" in bare:
        raise NotReadOnly("one statement at a time")
    words = re.findall(r"[A-Za-z_]+", bare.lower())
    if not words or words[0] not in ALLOWED:
        raise NotReadOnly(f"statement begins with {words[0] if words else 'nothing'}")
    for w in words:
        if w in BANNED and not re.search(rf"\b{w}\s*\(", bare, re.I):
            raise NotReadOnly(f"{w} is not allowed")
    if re.search(r"\b(?:reflect|java_method|try_reflect)\s*\(", bare, re.I):
        raise NotReadOnly("calls into the JVM are not allowed")
    return bare


def run(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Checks the text, then the analysed plan: commands are refused even where the text looks harmless."""
    check(sql)
    df = spark.sql(sql, args=args) if args else spark.sql(sql)
    plan = df._jdf.queryExecution().analyzed().getClass().getSimpleName()
    if plan.endswith("Command") and not plan.startswith(("Explain", "Describe", "Show")):
        raise NotReadOnly(f"{plan} is not a query")
    return df


# First words of graph patterns that read, what must not stand in them, and procedures that may be called.
PATTERN_ALLOWED = frozenset("match optional return with unwind".split())
PATTERN_BANNED = frozenset("create merge delete set remove drop alter copy import export checkpoint install detach load foreach".split())
PATTERN_CALLS = frozenset(("query_fts_index", "query_vector_index"))


def check_pattern(text: str) -> str:
    """A graph pattern that only reads: its first word, the words in it, and the procedures it calls."""
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|//[^\n]*|/\*.*?\*/", " ", text, flags=re.S).strip().rstrip(";").strip()
    words = re.findall(r"[A-Za-z_]\w*", bare.lower())
    if not words:
        raise NotReadOnly("empty statement")
    if ";" in bare:
        raise NotReadOnly("one statement at a time")
    calls = [c.lower() for c in re.findall(r"\bcall\s+([\w.]+)", bare, re.I)]
    for c in calls:
        if c not in PATTERN_CALLS:
            raise NotReadOnly(f"{c} may not be called")
    if words[0] not in PATTERN_ALLOWED and not (words[0] == "call" and calls):
        raise NotReadOnly(f"statement begins with {words[0]}")
    # a property may be named like a clause: what follows a dot is no clause
    for w in re.findall(r"(?<![.\w:])[A-Za-z_]\w*", bare):
        if w.lower() in PATTERN_BANNED:
            raise NotReadOnly(f"{w.lower()} is not allowed")
    return bare


RENDERED = 100
_SAFE = 2**53 - 1


def rendered(df: DataFrame, limit: int = RENDERED) -> tuple[list[dict], bool]:
    """The first ``limit`` rows as plain values, and whether there are more; integers that a double cannot hold become texts."""
    rows = df.limit(limit + 1).collect()
    plain = lambda v: str(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) > _SAFE else v
    return [{k: plain(v) for k, v in r.asDict().items()} for r in rows[:limit]], len(rows) > limit
