"""Queries of problems 2 (documented functions) and 4 (oversized chunks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import chunking as K
from graphloom.llm import code_docs as C


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return C.documented(spark.read.parquet(f"{d}/nodes.parquet"))


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return C.pairs(spark.read.parquet(f"{d}/nodes.parquet"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return K.oversized(spark.read.parquet(f"{d}/ast_chunks.parquet"), spark.read.parquet(f"{d}/nodes.parquet"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return K.oversized_pieces(spark.read.parquet(f"{d}/ast_chunks.parquet"), spark.read.parquet(f"{d}/nodes.parquet"))


def p4_cover(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of every oversized chunk cover it, keep the limit and overlap."""
    return K.coverage(p4_pieces(spark, d))


_NODE_COLUMNS = (
    "kind name file_path start_line end_line language content content_hash signature description owner parameter_count "
    "return_type is_exported cyclomatic_complexity repo_uri indexed_at removed_at"
).split()

QUERIES = {"p2_found": p2_found, "p2_pairs": p2_pairs, "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}
_FILES = f"""files AS (
        SELECT file_path, octet_length(encode(replace(content, chr(13) || chr(10), chr(10)))) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY id ORDER BY {" + ".join(f"({c} IS NOT NULL)::INT" for c in _NODE_COLUMNS)} DESC) AS r
          FROM nodes WHERE kind = 'File' AND id IS NOT NULL) WHERE r = 1 AND content IS NOT NULL),
      spans AS (SELECT DISTINCT path, greatest(coalesce(start_byte, 0), 0) AS start_byte, least(coalesce(end_byte, n), n) AS end_byte
        FROM ast_chunks JOIN files ON path = file_path WHERE least(coalesce(end_byte, n), n) - greatest(coalesce(start_byte, 0), 0) > 4096)"""
SQL = {
    "p4_found": f"WITH {_FILES} SELECT DISTINCT path, start_byte FROM spans",
    # the operator's promise for every chunk that has to be cut
    "p4_cover": f"WITH {_FILES} SELECT path, start_byte, end_byte, true AS covered, true AS within, true AS overlapping FROM spans",
}
