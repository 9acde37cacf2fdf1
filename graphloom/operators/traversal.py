"""Bounded traversal: a frontier loop that keeps the shortest depth and smallest path per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import Staging

# Relation types that a change travels along.
IMPACT_TYPES = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY"]


def query_set(nodes: DataFrame, kinds: list[str], every: int = 20) -> DataFrame:
    """``start``: the stated query set of traversals, every ``every``-th symbol by the hash of its id, over all kinds given."""
    pick = F.conv(F.substring(F.sha2("id", 256), 1, 4), 16, 10).cast("int") % every == 0
    return nodes.where(F.col("kind").isin(kinds) & pick).select(F.col("id").alias("start"))


def _steps(edges: DataFrame, types: list[str] | None, direction: str, min_confidence: float) -> DataFrame:
    e = edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    if types:
        e = e.where(F.col("type").isin(types))
    if min_confidence > 0:
        e = e.where(F.col("confidence") >= min_confidence)
    down = e.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    up = e.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"down": down, "up": up, "both": down.unionByName(up)}[direction]
    return steps.where("a <> b").distinct()


def traverse(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, direction: str = "down", max_depth: int = 3,
             min_confidence: float = 0.0) -> DataFrame:
    """``start, node_id, depth, path`` of every node reached from each start (``starts(start)``), itself excluded.

    Many starts walk in one job.  Per (start, node) the shortest depth counts, then the smallest path.
    Each depth costs one join with the edges and one anti-join with what is known; the frontier is
    written between depths, so neither lineage nor plan grows.
    """
    spark = edges.sparkSession
    st = Staging(spark, "traverse")
    steps = _steps(edges, types, direction, min_confidence)
    frontier = starts.select("start").distinct().select("start", F.col("start").alias("node_id"), F.lit(0).alias("depth"), F.array("start").alias("path"))
    seen = frontier.select("start", "node_id")
    out = frontier.limit(0)
    for d in range(1, max_depth + 1):
        step = frontier.join(steps, frontier["node_id"] == steps["a"]).select("start", F.col("b").alias("node_id"), F.concat("path", F.array("b")).alias("path"))
        best = step.groupBy("start", "node_id").agg(F.min("path").alias("path"))
        new = best.join(seen, ["start", "node_id"], "left_anti").select("start", "node_id", F.lit(d).alias("depth"), "path")
        frontier = st.cut(new, f"depth{d}")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
        seen = seen.unionByName(frontier.select("start", "node_id"))
    return out


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, min_confidence: float = 0.7) -> DataFrame:
    """``start, d1, d2, d3, n, score, risk_by_count, risk_by_score`` of what depends on each start, tests apart."""
    from graphloom.operators.finders import without_tests

    hit = traverse(edges, starts, IMPACT_TYPES, "up", depth, min_confidence)
    known = nodes.select(F.col("id").alias("node_id"), "file_path")
    kept = without_tests(hit.join(known, "node_id"))
    g = kept.groupBy("start").agg(*[F.count_if(F.col("depth") == k).alias(f"d{k}") for k in (1, 2, 3)], F.count(F.lit(1)).alias("n"))
    score = F.col("d1") * 3 + F.col("d2") + F.col("d3") * 0.3
    return g.withColumn("score", score).withColumn("risk_by_count", risk_by_count(F.col("n"))).withColumn("risk_by_score", risk_by_score(score))


def risk_by_count(n, processes=None):
    p = F.lit(0) if processes is None else processes
    return F.when((n >= 1000) | (p >= 5), "CRITICAL").when((n >= 100) | (p >= 2), "HIGH").when(n >= 10, "MEDIUM").otherwise("LOW")


def risk_by_score(score):
    return F.when(score >= 30, "CRITICAL").when(score >= 10, "HIGH").when(score >= 3, "MEDIUM").otherwise("LOW")


def closure(imports: DataFrame, changed: DataFrame, depth: int = 2) -> DataFrame:
    """``file, depth``: changed files (depth 0) with what imports them or is imported by them up to a depth.

    All changed files walk as one set, as only the least depth of a file counts: a file enters the frontier
    once, whatever number of changed files reach it, so what is written is at most the files and their steps.
    """
    st = Staging(imports.sparkSession, "closure")
    pairs = st.cut(_steps(imports, None, "down", 0), "pairs")
    frontier = st.cut(changed.select("file").distinct().withColumn("depth", F.lit(0)), "depth0")
    out = frontier
    for d in range(1, depth + 1):
        near = [pairs.join(frontier.select(F.col("file").alias(a)), a, "left_semi").select(F.col(b).alias("file")) for a, b in (("a", "b"), ("b", "a"))]
        new = near[0].unionByName(near[1]).distinct().join(out.select("file"), "file", "left_anti")
        frontier = st.cut(new.withColumn("depth", F.lit(d)), f"depth{d}")
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out
