"""Measures of source text: decisions, lines, nesting and vocabulary of callables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is no code, what decides, what operates, and what is operated on.
NO_CODE = r"//[^\n]*|#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'"
DECISIONS = r"\b(?:if|elif|for|while|case|catch|except)\b|&&|\|\||\band\b|\bor\b"
OPERATORS = r"[-+*/%=<>!&|^~?:]+|\b(?:if|else|for|while|return|case|switch|try|catch|throw|new|in|not|and|or|def|func|fn|function|class|import|from|const|let|var)\b"
OPERANDS = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?"


def measured(code: Column) -> dict[str, Column]:
    """``cyclomatic, nloc, volume, depth`` of a text: 1 + decisions, lines that hold more than blanks, Halstead volume, deepest indentation in steps."""
    bare = F.regexp_replace(code, NO_CODE, " ")
    ops = F.regexp_extract_all(bare, F.lit(f"({OPERATORS})"), 1)
    names = F.filter(F.regexp_extract_all(bare, F.lit(f"({OPERANDS})"), 1), lambda x: ~x.rlike(f"^(?:{OPERATORS})$"))
    total, kinds = F.size(ops) + F.size(names), F.size(F.array_distinct(ops)) + F.size(F.array_distinct(names))
    lines = F.filter(F.split(code, "\n"), lambda x: F.trim(x) != "")
    width = F.transform(lines, lambda x: F.length(F.regexp_extract(F.regexp_replace(x, "\t", "    "), r"^( *)", 1)))
    return {
        "cyclomatic": F.size(F.regexp_extract_all(bare, F.lit(f"({DECISIONS})"), 1)) + 1,
        "nloc": F.size(lines),
        "volume": F.when(kinds > 0, F.floor(total * F.log2(kinds.cast("double")) * 1000 + 0.5) / 1000).otherwise(F.lit(0.0)),
        "depth": F.coalesce(F.floor((F.array_max(width) - F.array_min(width)) / 4).cast("int"), F.lit(0)),
    }


def callables_measured(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """``id, cyclomatic, nloc, volume, depth`` of each callable with lines whose file is there.

    The spans of a file travel to its content, not the content to each span; the lines are cut there.
    """
    spans = nodes.where(F.col("kind").isin("Function", "Method") & F.col("start_line").isNotNull() & (F.col("end_line") >= F.col("start_line")) & F.col("file_path").isNotNull()).groupBy("file_path").agg(
        F.collect_list(F.struct("id", "start_line", "end_line")).alias("spans")
    )
    j = files.where("content is not null").select("file_path", F.split(F.regexp_replace("content", "\r\n", "\n"), "\n").alias("lines")).join(spans, "file_path")
    code = F.array_join(F.slice("lines", F.greatest(F.col("s.start_line"), F.lit(1)), F.col("s.end_line") - F.greatest(F.col("s.start_line"), F.lit(1)) + 1), "\n")
    cut = j.select(F.explode("spans").alias("s"), "lines").select("s.id", code.alias("code"))
    return cut.select("id", *[c.alias(n) for n, c in measured(F.col("code")).items()])
