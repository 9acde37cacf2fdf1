"""Interval, stabbing, as-of and tiered joins.

Line ranges join on the file first.  A file whose symbols or probes are many is no problem: ranges are
cut into bins of lines, so the equi part of the join is (file, bin) and no file is one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines per bin of the range joins.
BIN_LINES = 64


def _bins(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence((F.col(start) / BIN_LINES).cast("int"), (F.greatest(F.col(end), F.col(start)) / BIN_LINES).cast("int"))))


def overlapping(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """``hunk_id, symbol_id, first_line, last_line, n_lines``: hunks on symbols of the same file.

    ``hunks(hunk_id, file_path, start, count)`` end on their start where the count is 0;
    ``symbols(id, kind, file_path, start_line, end_line)`` that are files or folders, or have no lines, are left out.
    """
    h = hunks.where("start is not null and file_path is not null").select(
        "hunk_id", "file_path", F.col("start").alias("h1"), F.when(F.coalesce("count", F.lit(0)) == 0, F.col("start")).otherwise(F.col("start") + F.col("count") - 1).alias("h2")
    )
    s = symbols.where("start_line is not null and end_line is not null and kind not in ('File', 'Folder')").select(
        F.col("id").alias("symbol_id"), "file_path", F.col("start_line").alias("s1"), F.col("end_line").alias("s2")
    )
    first, last = F.greatest("h1", "s1"), F.least("h2", "s2")
    j = _bins(h, "h1", "h2").join(_bins(s, "s1", "s2"), ["file_path", "_bin"]).where("h2 >= s1 and h1 <= s2")
    # a pair that shares several bins counts in the first of them
    j = j.where(F.col("_bin") == (F.greatest("h1", "s1") / BIN_LINES).cast("int"))
    return j.select("hunk_id", "symbol_id", first.alias("first_line"), last.alias("last_line"), (last - first + 1).alias("n_lines"))


def innermost(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``probe_id, symbol_id, span``: the smallest symbol around each probe line.

    Ties go to the smaller start, end and id.  ``probes(probe_id, file_path, line)``.
    """
    p = probes.where("line is not null").withColumn("_bin", (F.col("line") / BIN_LINES).cast("int"))
    s = _bins(
        symbols.where("start_line is not null and end_line is not null").select(
            F.col("id").alias("symbol_id"), "file_path", F.col("start_line").alias("s1"), F.col("end_line").alias("s2")
        ), "s1", "s2",
    )
    j = p.join(s, ["file_path", "_bin"]).where("line between s1 and s2")
    best = j.groupBy("probe_id").agg(F.min(F.struct((F.col("s2") - F.col("s1")).alias("span"), "s1", "s2", "symbol_id")).alias("b"))
    return best.select("probe_id", "b.symbol_id", "b.span")


def latest_start(probes: DataFrame, symbols: DataFrame) -> DataFrame:
    """``probe_id, symbol_id``: the symbol with the greatest start around each probe, null without one."""
    p = probes.withColumn("_bin", (F.col("line") / BIN_LINES).cast("int"))
    s = _bins(
        symbols.where("start_line is not null and end_line is not null").select(
            F.col("id").alias("symbol_id"), "file_path", F.col("start_line").alias("s1"), F.col("end_line").alias("s2")
        ), "s1", "s2",
    )
    cond = (p["file_path"] == s["file_path"]) & (p["_bin"] == s["_bin"]) & (p["line"] >= s["s1"]) & (p["line"] <= s["s2"])
    j = p.join(s, cond, "left")
    return j.groupBy("probe_id").agg(F.max(F.struct("s1", "symbol_id")).alias("b")).select("probe_id", "b.symbol_id")


def preceded(events: DataFrame, before: str, after: str, seconds: int) -> DataFrame:
    """Events of type ``after`` with one of type ``before`` of the same user strictly earlier, at most ``seconds`` ago.

    A running maximum of the earlier times replaces the range join: one pass per user, no pairs.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = events.where(F.col("event_type").isin(before, after)).select("event_id", "user_id", "event_type", t.alias("t"))
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    seen = e.withColumn("last", F.max(F.when(F.col("event_type") == before, F.col("t"))).over(w))
    return seen.where((F.col("event_type") == after) & (F.col("t") - F.col("last") <= seconds * 1_000_000)).select("event_id", "user_id")


def tiered(names: DataFrame, index: DataFrame) -> DataFrame:
    """``ref_id, target, tier, confidence``: same file 0.95, else same repository 0.9, else anywhere 0.5.

    ``names(ref_id, name, file_path, repo_uri)``, ``index(id, name, file_path, repo_uri)``.  Within a tier
    the smallest id answers.  Each tier joins a table reduced to its smallest id per key, so a common
    name makes no pairs.
    """
    f = index.groupBy("name", "file_path").agg(F.min("id").alias("in_file"))
    r = index.where("repo_uri is not null").groupBy("name", "repo_uri").agg(F.min("id").alias("in_repo"))
    g = index.groupBy("name").agg(F.min("id").alias("anywhere"))
    j = names.join(f, ["name", "file_path"], "left").join(r, ["name", "repo_uri"], "left").join(g, "name", "left")
    target = F.coalesce("in_file", "in_repo", "anywhere")
    tier = F.when(F.col("in_file").isNotNull(), "same-file").when(F.col("in_repo").isNotNull(), "import").when(F.col("anywhere").isNotNull(), "global")
    conf = F.when(F.col("in_file").isNotNull(), 0.95).when(F.col("in_repo").isNotNull(), 0.9).when(F.col("anywhere").isNotNull(), 0.5)
    return j.select("ref_id", target.alias("target"), tier.alias("tier"), conf.alias("confidence"))


def cross_repo(edges: DataFrame, nodes: DataFrame, type_: str) -> DataFrame:
    """Edges of a type whose ends lie in different repositories, with both repositories."""
    slim = nodes.select("id", "repo_uri")
    e = edges.where((F.col("type") == type_) & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("id", "src", "dst")
    a = slim.select(F.col("id").alias("src"), F.col("repo_uri").alias("src_repo"))
    b = slim.select(F.col("id").alias("dst"), F.col("repo_uri").alias("dst_repo"))
    return e.join(a, "src").join(b, "dst").where("src_repo <> dst_repo").select("id", "src", "dst", "src_repo", "dst_repo")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Touching ranges ``[start, end)`` of a key coalesce, empty ones drop."""
    w = Window.partitionBy(key).orderBy(start, end)
    d = df.where(F.col(end) > F.col(start)).select(key, start, end).distinct()
    far = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_far", far)
    isle = F.sum(F.when(F.col("_far").isNull() | (F.col(start) > F.col("_far")), 1).otherwise(0)).over(w)
    return d.withColumn("_isle", isle).groupBy(key, "_isle").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_isle")
