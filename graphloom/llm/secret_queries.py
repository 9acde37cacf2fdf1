"""Queries of problem 6 (credentials)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import secrets as S


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return S.secret_lines(spark.read.parquet(f"{d}/nodes.parquet"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return S.redacted(spark.read.parquet(f"{d}/nodes.parquet"))


QUERIES = {"p6_found": p6_found, "p6_redacted": p6_redacted}
SQL: dict = {}
