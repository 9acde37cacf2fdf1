"""Queries of problems 1 (files not written by hand) and 9 (residue instead of content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import handwritten as H
from graphloom.llm import residue as R


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return H.not_handwritten(spark.read.parquet(f"{d}/nodes.parquet"))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Files per reason; a null reason counts the hand-written ones."""
    return H.classify_files(spark.read.parquet(f"{d}/nodes.parquet")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_files"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return R.residue(spark.read.parquet(f"{d}/documents.parquet"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that stay."""
    return R.residue_evidence(spark.read.parquet(f"{d}/documents.parquet")).where("not residue").select("doc_id")


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p9_found": p9_found, "p9_clean": p9_clean}
SQL: dict = {}
