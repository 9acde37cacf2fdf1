"""Edges from an indexer's occurrences: ranges of lines and characters, calls, upgrades of what was guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.joins import BIN_LINES, _bins

_R = ["start_line", "start_char", "end_line", "end_char"]


def enclosing(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """``site_id, symbol``: the smallest definition around each site by lines, then characters; ties to the smaller symbol.

    ``sites(site_id, file_path, start_line, start_char, end_line, end_char)``, ``defs(symbol, file_path, ...)``
    with the same range.  A definition is around a site if it begins at or before it and ends at or after.
    """
    s = sites.where("start_line is not null").select("site_id", "file_path", *[F.col(c).alias(f"s_{c}") for c in _R], (F.col("start_line") / BIN_LINES).cast("int").alias("_bin"))
    d = _bins(defs.where("start_line is not null and end_line is not null"), "start_line", "end_line").select("symbol", "file_path", "_bin", *_R)
    at = lambda p, w: F.struct(F.col(f"{p}{w}_line"), F.coalesce(F.col(f"{p}{w}_char"), F.lit(0)))
    j = s.join(d, ["file_path", "_bin"]).where((at("", "start") <= at("s_", "start")) & (at("", "end") >= at("s_", "end")))
    lines = F.col("end_line") - F.col("start_line")
    chars = F.coalesce("end_char", F.lit(0)) - F.coalesce("start_char", F.lit(0))
    best = j.groupBy("site_id").agg(F.min(F.struct(lines.alias("lines"), chars.alias("chars"), "symbol")).alias("b"))
    return best.select("site_id", "b.symbol")


def derived_edges(occurrences: DataFrame, defs: DataFrame) -> DataFrame:
    """``src, dst, type``: what each occurrence says, from the innermost definition around it.

    ``occurrences(site_id, file_path, <range>, symbol, role)``: definitions, imports and local symbols say
    nothing.  An occurrence of a function-like symbol within a function-like definition is a call (a
    symbol ends in ``().`` if it is function-like), any other a reference.  A symbol is no caller of itself.
    """
    used = occurrences.where(~F.col("role").isin("definition", "import") & ~F.col("symbol").startswith("local "))
    around = enclosing(used, defs.where(F.col("symbol").endswith("()."))).select("site_id", F.col("symbol").alias("src"))
    called = F.col("dst").endswith("().")
    return used.select("site_id", F.col("symbol").alias("dst")).join(around, "site_id").where("src <> dst").select(
        "src", "dst", F.when(called, "CALLS").otherwise("REFERENCES").alias("type")
    ).distinct()


def upgraded(derived: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, type, confidence, outcome``: derived edges at 1.0; ``upgraded`` where one was known below that, ``known`` at it, else ``emitted``."""
    have = edges.where("src is not null and dst is not null").groupBy("src", "dst", "type").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("was"))
    j = derived.select("src", "dst", "type").distinct().join(have, ["src", "dst", "type"], "left")
    outcome = F.when(F.col("was").isNull(), "emitted").when(F.col("was") < 1.0, "upgraded").otherwise("known")
    return j.select("src", "dst", "type", F.lit(1.0).alias("confidence"), outcome.alias("outcome"))


def heritage(names: DataFrame, index: DataFrame) -> DataFrame:
    """``src, dst, type, confidence``: EXTENDS and IMPLEMENTS with the confidence of the tier that resolved them.

    ``names(src, name, file_path, repo_uri, kind)``, where kind tells ``class`` or ``interface`` of what is
    named; of several candidates the first by id counts.
    """
    from graphloom.operators.joins import tiered

    t = tiered(names.select(F.col("src").alias("ref_id"), "name", "file_path", "repo_uri"), index)
    kind = names.select(F.col("src").alias("ref_id"), "kind")
    return t.where("target is not null and target <> ref_id").join(kind, "ref_id").select(
        F.col("ref_id").alias("src"), F.col("target").alias("dst"), F.when(F.col("kind") == "interface", "IMPLEMENTS").otherwise("EXTENDS").alias("type"), "confidence"
    )
