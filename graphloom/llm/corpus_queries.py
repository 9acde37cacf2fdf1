"""Queries of problems 7 (leaked evaluation texts) and 8 (source mix)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import leaks as L
from graphloom.llm import mixing as M


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return L.leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/eval_items.parquet"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that leak it."""
    found = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "task").join(found, "item_id", "left").fillna({"n_docs": 0})


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return M.mix(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return M.shares(p8_mix(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))


def p8_shards(spark: SparkSession, d: str) -> DataFrame:
    """The draw of every output shard."""
    p = M.planned(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet"))
    return M.shard_counts(p.slots)


def p8_kept(spark: SparkSession, d: str) -> DataFrame:
    """Per source whether the cap on repeats and the target share are kept, within a hundredth of the total and two blocks, the unit of the mix."""
    docs, targets = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/mix_targets.parquet")
    told = M.shares(M.mix(docs, targets), targets)
    have = docs.where("text is not null and text <> ''").select(M.tidy(F.col("source")).alias("source")).distinct().withColumn("has", F.lit(True))
    caps = targets.select(M.tidy(F.col("source")).alias("source"), "max_repeats")
    live = told.join(F.broadcast(caps), "source").join(have, "source", "left")
    sums = live.agg(F.sum(F.when(F.col("has"), F.col("target_share"))).alias("scale"), F.sum("tokens_used").alias("used")).first()
    near = 0.01 + 2.0 * M.BLOCK_TOKENS / max(1, sums["used"] or 0)
    fit = F.when(F.col("has"), F.abs(F.col("actual_share") - F.col("target_share") / F.lit(sums["scale"] or 1.0)) <= F.lit(near)).otherwise(F.col("n_records") == 0)
    return live.select("source", (F.col("max_used") <= F.col("max_repeats")).alias("within_cap"), fit.alias("share_kept"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_shards": p8_shards, "p8_kept": p8_kept}
SQL: dict = {
    # the operator's promise for every target source
    "p8_kept": """SELECT DISTINCT regexp_replace(lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))), '[ -]+', '_', 'g') AS source, true AS within_cap, true AS share_kept
        FROM mix_targets WHERE source IS NOT NULL""",
}
