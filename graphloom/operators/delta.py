"""Delta and decision operators: baselines, shape checks, cross-repository links, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import glob_regex, license_tier


def baseline(old: DataFrame, new: DataFrame, key: list[str], body: list[str]) -> DataFrame:
    """``*key, state``: new, fixed, unchanged or updated.  Of several rows with one key the smallest body counts."""

    def fold(d: DataFrame, side: str) -> DataFrame:
        return d.groupBy(*[F.col(k).alias(f"{side}_{k}") for k in key]).agg(F.min(F.struct(*body)).alias(side))

    cond = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key]
    j = fold(old, "o").join(fold(new, "n"), cond, "full")
    state = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "fixed").when(F.col("o").eqNullSafe(F.col("n")), "unchanged").otherwise("updated")
    return j.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in key], state.alias("state"))


def merge_logs(*logs: DataFrame) -> DataFrame:
    out = logs[0]
    for x in logs[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def suppress(findings: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``suppressed`` per finding: some rule names its rule id (or ``*``) and its path glob matches."""
    hit = F.lit(False)
    for rule, glob in rules:
        on_rule = F.lit(True) if rule == "*" else F.col("rule_id") == rule
        hit = hit | (on_rule & F.coalesce(F.col("path").rlike(glob_regex(glob)), F.lit(False)))
    return findings.withColumn("suppressed", hit)


def fingerprint(scanner, rule, path, context):
    """The first 32 digits of SHA-256 over the NUL-joined parts, the context hashed with white space folded."""
    nul = F.decode(F.unhex(F.lit("00")), "UTF-8")
    ctx = F.sha2(F.trim(F.regexp_replace(context, r"\s+", " ")), 256)
    return F.substring(F.sha2(F.concat(scanner, nul, rule, nul, path, nul, ctx), 256), 1, 32)


def shape_check(accessed, known):
    """PARTIAL without accesses, MATCH if all are known, else MISMATCH."""
    return F.when(F.size(accessed) == 0, "PARTIAL").when(F.size(F.array_except(accessed, known)) == 0, "MATCH").otherwise("MISMATCH")


def cross_links(pairs: DataFrame) -> DataFrame:
    """Both directions of each producer-consumer pair: ``consumer_of`` and ``depends_on``; unknown repositories drop."""
    ok = pairs.where("producer_repo is not null and consumer_repo is not null")
    both = F.array(
        F.struct(F.col("producer_repo").alias("source_repo_uri"), F.col("consumer_repo").alias("target_repo_uri"), F.lit("consumer_of").alias("relation")),
        F.struct(F.col("consumer_repo").alias("source_repo_uri"), F.col("producer_repo").alias("target_repo_uri"), F.lit("depends_on").alias("relation")),
    )
    return ok.select(F.explode(both).alias("x")).select("x.*").distinct()


def decision_diff(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """``key, in_a, in_b, delta``: what only one side has, and where the values differ."""
    j = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key, "full")
    return j.where(F.col("va").isNull() | F.col("vb").isNull() | (F.col("va") != F.col("vb"))).select(
        key, F.col("va").isNotNull().alias("in_a"), F.col("vb").isNotNull().alias("in_b"), (F.col("vb") - F.col("va")).alias("delta")
    )


def policy(deps: DataFrame, denied: list[str]) -> DataFrame:
    """``id, tier, decision`` per dependency: denied licences block, unknown ones warn."""
    tier = license_tier(F.col("license"))
    decision = F.when(F.upper(F.trim("license")).isin([x.upper() for x in denied]), "block").when(tier == "unknown", "warn").otherwise("pass")
    return deps.select("id", tier.alias("tier"), decision.alias("decision"))


def tier(radius: Column, modules: Column, risky: Column, errors: Column | None = None, warnings: Column | None = None, density: Column | None = None) -> Column:
    """``block``, ``expert``, ``dual``, ``single`` or ``auto`` by how far a change reaches.

    50 and more dependents block; 20, or an error, ask for an expert; 5, three modules, or a risky symbol for
    two reviewers; a warning, or more than 0.3 fixes after features, for one.
    """
    none = F.lit(0)
    return (
        F.when(radius >= 50, "block")
        .when((radius >= 20) | ((none if errors is None else errors) > 0), "expert")
        .when((modules >= 3) | risky | (radius >= 5), "dual")
        .when(((none if warnings is None else warnings) > 0) | ((none if density is None else density) > 0.3), "single")
        .otherwise("auto")
    )
