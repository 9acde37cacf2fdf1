"""Counting and grouping operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.scalars import CONFIRMED_PREFIX, COPYLEFT, license_tier

# The relation types, zero-filled in counts.
EDGE_TYPES = (
    "CONTAINS DEFINES IMPORTS CALLS EXTENDS IMPLEMENTS HAS_METHOD HAS_PROPERTY ACCESSES METHOD_OVERRIDES OVERRIDES METHOD_IMPLEMENTS MEMBER_OF PROCESS_STEP "
    "HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF WRAPS QUERIES REFERENCES FOUND_IN DEPENDS_ON OWNED_BY TYPE_OF"
).split()


def zero_filled(spark: SparkSession, counts: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    base = spark.createDataFrame([(w,) for w in wanted], f"{key} string")
    return base.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def count_by(df: DataFrame, key: str, wanted: list[str] | None = None) -> DataFrame:
    """Rows per value; the wanted values that have none count zero."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return c if wanted is None else zero_filled(df.sparkSession, c, key, wanted)


def grouped_examples(df: DataFrame, keys: list[str], id_col: str = "id", k: int = 3) -> DataFrame:
    """Count and the first k ids per group.

    Only k ids per group and task enter the exchange: a running top-k, not a collected group.
    """
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    salted = df.select(*keys, id_col, F.pmod(F.xxhash64(id_col), F.lit(64)).alias("_salt"))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(id_col)
    first = salted.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*keys).orderBy(id_col)
    top = first.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= k)
    ex = top.groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    cond = [n[c].eqNullSafe(ex[c]) for c in keys]
    return n.join(ex, cond).select(*[n[c] for c in keys], "n", "examples")


def license_audit(deps: DataFrame) -> DataFrame:
    """``ecosystem, n_copyleft, n_proprietary, n_unknown, n, verdict`` per ecosystem."""
    up = F.upper(F.trim("license"))
    tier = license_tier(F.col("license"))
    d = deps.select("ecosystem", F.coalesce(up.rlike(COPYLEFT), F.lit(False)).alias("c"), (tier == "proprietary").alias("p"), (F.col("license").isNull() | (up == "")).alias("u"))
    g = d.groupBy("ecosystem").agg(
        F.count_if("c").alias("n_copyleft"), F.count_if("p").alias("n_proprietary"), F.count_if("u").alias("n_unknown"), F.count(F.lit(1)).alias("n")
    )
    verdict = F.when((F.col("n_copyleft") > 0) | (F.col("n_proprietary") > 0), "BLOCK").when(F.col("n_unknown") > 0, "WARN").otherwise("OK")
    return g.withColumn("verdict", verdict)


def confidence_breakdown(edges: DataFrame, by: str = "type") -> DataFrame:
    """Confirmed (at least 0.95 by an indexer), unknown (at most 0.2) and heuristic edges."""
    conf, c = F.col("confidence"), F.coalesce(F.col("reason").startswith(CONFIRMED_PREFIX), F.lit(False))
    confirmed = (conf >= 0.95) & c
    unknown = ~F.coalesce(confirmed, F.lit(False)) & (conf <= 0.2)
    return edges.groupBy(by).agg(
        F.count_if(confirmed).alias("confirmed"),
        F.count_if(unknown).alias("unknown"),
        F.count_if(~F.coalesce(confirmed, F.lit(False)) & ~F.coalesce(unknown, F.lit(False))).alias("heuristic"),
    )


def language_shares(nodes: DataFrame) -> DataFrame:
    """Every language of a repository has the same share, however many files it has."""
    langs = nodes.where((F.col("kind") == "File") & F.col("language").isNotNull()).select("repo_uri", "language").distinct()
    return langs.withColumn("share", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("repo_uri")))


def dispersion(df: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """Population deviation, mean and share of different values per group; fewer than two rows disperse by zero."""
    n = F.count(value)
    return df.groupBy(key).agg(
        n.alias("n"),
        F.avg(value).alias("mean"),
        F.when(n < 2, 0.0).otherwise(F.stddev_pop(value)).alias("deviation"),
        (F.count_distinct(what) / F.count(what)).alias("distinct_ratio"),
    )


def median_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """An even count averages the two middle values."""
    return df.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def last_wins(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key: that of the greatest ordinal."""
    return df.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_b")).select(key, "_b.*")


def complex_files(nodes: DataFrame, most: int = 10) -> DataFrame:
    """``file_path, max_complexity, flagged``: the most complex callable of each file."""
    ok = nodes.where(F.col("cyclomatic_complexity").isNotNull() & F.col("file_path").isNotNull())
    return ok.groupBy("file_path").agg(F.max("cyclomatic_complexity").alias("max_complexity")).withColumn("flagged", F.col("max_complexity") > most)
