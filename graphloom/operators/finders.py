"""Typed finders over the graph tables.  All sort by a total key; an empty list of kinds or ids finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.scalars import is_test_path


def _slice(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if offset and offset > 0:
        df = df.offset(int(offset))
    if limit is not None and limit == limit and limit >= 0:
        df = df.limit(int(limit))
    return df


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def list_nodes(nodes: DataFrame, kinds: list[str] | None = None, ids: DataFrame | list[str] | None = None, file_path: str | None = None,
               limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Conjunctive filter.  Many ids come as a table, which is semi-joined, never as a list of literals."""
    if kinds is not None:
        nodes = nodes.where(F.col("kind").isin(kinds)) if kinds else nodes.limit(0)
    if ids is not None:
        if isinstance(ids, list):
            nodes = nodes.where(F.col("id").isin(ids)) if ids else nodes.limit(0)
        else:
            nodes = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    if file_path is not None:
        nodes = nodes.where(F.col("file_path") == file_path)
    return _slice(nodes.orderBy("id"), limit, offset)


def list_by_kind(nodes: DataFrame, kind: str, path_like: str | None = None) -> DataFrame:
    """``path_like`` is a substring regardless of ASCII case."""
    found = nodes.where(F.col("kind") == kind)
    if path_like is not None:
        found = found.where(F.lower("file_path").contains(path_like.lower()))
    return found.orderBy("id")


def list_by_name(nodes: DataFrame, name: str, kinds: list[str] | None = None, file_path: str | None = None) -> DataFrame:
    found = nodes.where(F.col("name") == name)
    if kinds is not None:
        found = found.where(F.col("kind").isin(kinds)) if kinds else found.limit(0)
    if file_path is not None:
        found = found.where(F.col("file_path") == file_path)
    return found.orderBy("id")


def list_edges(edges: DataFrame, types: list[str] | None = None, src: list[str] | None = None, dst: list[str] | None = None,
               min_confidence: float | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """An empty list is no filter here; confidence compares with at least."""
    for col, values in (("type", types), ("src", src), ("dst", dst)):
        if values:
            edges = edges.where(F.col(col).isin(values))
    if min_confidence is not None:
        edges = edges.where(F.col("confidence") >= min_confidence)
    return _slice(edges.orderBy("src", "dst", "type", "id"), limit, offset)


def cochanges_for(cochanges: DataFrame, files: DataFrame | str, min_lift: float = 1.0, limit: int = 10) -> DataFrame:
    """The strongest partners of a file: lift descending, then source and target."""
    found = cochanges.where(((F.col("source_file") == files) | (F.col("target_file") == files)) & (F.col("lift") >= min_lift))
    return found.orderBy(F.desc("lift"), "source_file", "target_file").limit(limit)


def cochanges_between(cochanges: DataFrame, a: str, b: str) -> DataFrame:
    one = (F.col("source_file") == a) & (F.col("target_file") == b)
    two = (F.col("source_file") == b) & (F.col("target_file") == a)
    return cochanges.where(one | two).orderBy("source_file", "target_file").limit(1)


def resolve_target(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """``query, id, n_candidates, ambiguous``: a target is an id where it looks like one, else a name.

    Takes a table of ``query``; a text with two colons looks like an id.  Stubs named
    ``<unresolved>`` are dropped where anything else answers.
    """
    looks = F.size(F.split("query", ":")) >= 3
    slim = nodes.select("id", "name", "file_path")
    by_id = targets.where(looks).join(slim, F.col("query") == F.col("id"))
    by_name = targets.where(~looks).join(slim, F.col("query") == F.col("name"))
    found = by_id.unionByName(by_name).withColumn("stub", F.coalesce(F.col("file_path"), F.lit("")) == "<unresolved>")
    per = found.groupBy("query").agg(F.count_if(~F.col("stub")).alias("real"), F.count(F.lit(1)).alias("all"))
    kept = found.join(per, "query").where(~F.col("stub") | (F.col("real") == 0))
    n = F.when(F.col("real") > 0, F.col("real")).otherwise(F.col("all"))
    return kept.select("query", "id", n.alias("n_candidates"), (n > 1).alias("ambiguous"))


def without_tests(df: DataFrame, path: Column | str = "file_path") -> DataFrame:
    return df.where(~F.coalesce(is_test_path(F.col(path) if isinstance(path, str) else path), F.lit(False)))


def list_embeddings(vectors: DataFrame, id_col: str, kind_col: str, kinds: list | None = None, limit: int | None = None) -> DataFrame:
    """Vectors of some kinds; in the order of their ids where a limit asks for the first."""
    out = vectors if kinds is None else vectors.where(F.col(kind_col).isin(kinds))
    return out if limit is None or limit < 0 else out.orderBy(id_col).limit(limit)
