"""Typed finders over findings, dependencies, routes and tools, and what is decided on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import license_tier


def _within(c: str, allowed: list[str] | None) -> Column:
    return F.lit(True) if allowed is None else F.col(c).isin(allowed)


def list_findings(findings: DataFrame, severity: list[str] | None = None, rule_id: str | None = None, state: list[str] | None = None, suppressed: bool | None = None) -> DataFrame:
    """Findings by severity, rule, baseline state, and whether a list of suppressions is there at all (None: either).

    ``findings(id, severity, rule_id, baseline_state, suppressed_json, ...)``.
    """
    cond = _within("severity", severity) & _within("baseline_state", state)
    if rule_id is not None:
        cond = cond & (F.col("rule_id") == rule_id)
    if suppressed is not None:
        cond = cond & (F.col("suppressed_json").isNotNull() if suppressed else F.col("suppressed_json").isNull())
    return findings.where(cond)


def search_findings(findings: DataFrame, severity: list[str] | None = None, rule_id: str | None = None, scanner: str | None = None, path_part: str | None = None, limit: int = 500) -> DataFrame:
    """The first ``limit`` findings by id that fit; severity and rule reach the scan, scanner and a part of the path follow."""
    out = list_findings(findings, severity, rule_id)
    if scanner is not None:
        out = out.where(F.col("scanner") == scanner)
    if path_part is not None:
        out = out.where(F.col("file_path").contains(path_part))
    return out.orderBy("id").limit(limit)


def list_dependencies(deps: DataFrame, ecosystem: str | None = None, tiers: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Dependencies of an ecosystem by id; the tier of the licence is asked for after the limit, as surveyed."""
    out = deps if ecosystem is None else deps.where(F.col("ecosystem") == ecosystem)
    if limit is not None:
        out = out.orderBy("id").limit(limit)
    out = out.withColumn("tier", license_tier(F.col("license")))
    return out.where(_within("tier", tiers))


def list_routes(routes: DataFrame, methods: list[str] | None = None, path_part: str | None = None) -> DataFrame:
    out = routes.where(_within("method", methods))
    return out if path_part is None else out.where(F.lower("url").contains(path_part.lower()))


def repo_node(nodes: DataFrame, id_: str) -> DataFrame:
    """The node with that id, if it is a repository."""
    return nodes.where((F.col("id") == id_) & (F.col("kind") == "Repo"))


def tool_map(tools: DataFrame, name_part: str, cap: int = 500) -> DataFrame:
    """Tools whose name holds a part, by name and file; the cap counts before the filter, as surveyed."""
    return tools.orderBy("id").limit(cap).where(F.lower("name").contains(name_part.lower())).orderBy("name", "file_path")


def file_histogram(members: DataFrame, k: int = 10) -> DataFrame:
    """``community, file_path, n, pos``: the files that hold most members of each community, ties by path."""
    g = members.where("community is not null and file_path is not null").groupBy("community", "file_path").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "file_path"))).where(F.col("pos") <= k)


def top_contributors(owned: DataFrame, k: int = 5) -> DataFrame:
    """``community, contributor, weight, pos``: contributors by the sum of confidence over a community's files, ties by id."""
    g = owned.groupBy("community", "contributor").agg(F.round(F.sum("confidence"), 6).alias("weight"))
    return g.withColumn("pos", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("weight"), "contributor"))).where(F.col("pos") <= k)


def untested_radius(edges: DataFrame, nodes: DataFrame, coverage: DataFrame, starts: DataFrame, types: list[str], thin: float = 0.5) -> DataFrame:
    """``start, direct, tested, untested, unknown``: direct dependents by their own coverage, else that of their file.

    ``coverage(id, file_path, ratio)``; the coverage of a file is the row whose id is the file's path.
    """
    hit = edges.where(F.col("type").isin(types) & F.col("src").isNotNull() & (F.col("src") != F.col("dst"))).join(starts, edges["dst"] == starts["start"]).select("start", "src").distinct()
    own = coverage.where("id is not null").select(F.col("id").alias("src"), F.col("ratio").alias("own"))
    of_file = coverage.where("id is null").select("file_path", F.col("ratio").alias("file_ratio"))
    j = hit.join(nodes.select(F.col("id").alias("src"), "file_path"), "src").join(own, "src", "left").join(of_file, "file_path", "left")
    r = F.coalesce("own", "file_ratio")
    return j.groupBy("start").agg(
        F.count(F.lit(1)).alias("direct"), F.count_if(r >= thin).alias("tested"), F.count_if(r < thin).alias("untested"), F.count_if(r.isNull()).alias("unknown")
    )


def sieve(domain: Column, serialization: Column, plumbing: Column, is_entity: Column) -> tuple[Column, Column]:
    """``(tier, confidence)``: pure serialization 0.95, plumbing without any domain signal 0.9, else abstained."""
    pure = (domain == 0) & (serialization > 0)
    pipe = (domain == 0) & (plumbing > 0) & ~is_entity
    return F.when(pure, "serialization-pure").when(pipe, "plumbing-no-domain").otherwise("none"), F.when(pure, 0.95).when(pipe, 0.9).otherwise(0.0)


def tagged(results: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Results with ``baseline_state``: the state of their key in a comparison, ``new`` where it has none."""
    return results.join(keys.select(*on, "state"), on, "left").withColumn("baseline_state", F.coalesce("state", F.lit("new"))).drop("state")


def carrying_scanners(catalogue: DataFrame, profile: DataFrame) -> DataFrame:
    """``scanner, repo_uri``: scanners that fit a repository, as one of its languages or tools is among what they need.

    ``catalogue(scanner, needs)``: ``needs`` null or ``*`` fits every repository.  ``profile(repo_uri, what)``.
    The catalogue is a list of tools of bounded size.
    """
    c = F.broadcast(catalogue)
    any_ = profile.select("repo_uri").distinct().withColumn("k", F.lit("*")).join(c.where("needs is null or needs = '*'").select("scanner", F.lit("*").alias("k")), "k")
    fit = profile.join(c, profile["what"] == c["needs"]).select("scanner", "repo_uri")
    return any_.select("scanner", "repo_uri").unionByName(fit).distinct()
