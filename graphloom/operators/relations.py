"""Edge-building and contextual joins: ownership, nesting, shapes, carry-over, contexts and packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.aggregates import grouped_examples
from graphloom.operators.finders import is_test_path
from graphloom.operators.joins import BIN_LINES, _bins


def top_per(df: DataFrame, key: str, value: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows per key; ties must be broken by ``order``."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(key, value, *[c for c in df.columns if c not in (key, value)], "pos")


def nesting(nodes: DataFrame) -> DataFrame:
    """``id, parent, relation, confidence`` of definitions.

    A nested definition hangs from its owner in the same file where the owner's name is unique there
    (HAS_METHOD for callables, else HAS_PROPERTY), else from the file at 0.9; others from the file at 1.0.
    """
    types = nodes.where(F.col("kind").isin("Class", "Struct") & F.col("file_path").isNotNull()).select(
        F.col("id").alias("owner_id"), "file_path", F.col("name").alias("owner"), F.count(F.lit(1)).over(Window.partitionBy("file_path", "name")).alias("k")
    ).where("k = 1").drop("k")
    files = nodes.where(F.col("kind") == "File").groupBy("file_path").agg(F.min("id").alias("file_id"))
    d = nodes.where(F.col("kind").isin("Function", "Method", "Class", "Struct", "Property") & F.col("file_path").isNotNull()).select("id", "kind", "owner", "file_path")
    j = d.join(types, ["file_path", "owner"], "left").join(files, "file_path", "left")
    nested, owned = F.col("owner").isNotNull(), F.col("owner_id").isNotNull()
    relation = F.when(owned & F.col("kind").isin("Function", "Method"), "HAS_METHOD").when(owned, "HAS_PROPERTY").otherwise("DEFINES")
    return j.select("id", F.coalesce("owner_id", "file_id").alias("parent"), relation.alias("relation"), F.when(nested & ~owned, 0.9).otherwise(1.0).alias("confidence"))


def carried(edges: DataFrame, nodes: DataFrame, closure: DataFrame, types: list[str], floor: float) -> DataFrame:
    """Earlier edges that stay: both ends known, neither file in the closure, confidence above the floor."""
    at = nodes.select("id", "file_path").where("file_path is not null").join(closure.select(F.col("file").alias("file_path")), "file_path", "left_anti").select("id")
    e = edges.where(F.col("type").isin(types) & (F.col("confidence") > floor))
    return e.join(at.select(F.col("id").alias("src")), "src", "left_semi").join(at.select(F.col("id").alias("dst")), "dst", "left_semi")


def shapes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, verdict, missing``: whether the properties a symbol accesses are declared anywhere in its file."""
    from graphloom.operators.delta import shape_check

    n = nodes.select("id", "name", "file_path")
    acc = edges.where((F.col("type") == "ACCESSES") & F.col("dst").isNotNull()).select("src", "dst").distinct()
    used = acc.join(n.select(F.col("id").alias("dst"), "name"), "dst").groupBy("src").agg(F.array_sort(F.collect_set("name")).alias("accessed"))
    known = nodes.where("kind = 'Property' and file_path is not null").groupBy("file_path").agg(F.array_sort(F.collect_set("name")).alias("known"))
    j = used.join(n.select(F.col("id").alias("src"), "file_path"), "src").join(known, "file_path", "left")
    k = F.coalesce("known", F.array().cast("array<string>"))
    return j.select("src", shape_check(F.col("accessed"), k).alias("verdict"), F.array_sort(F.array_except("accessed", k)).alias("missing"))


def line_shares(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_id, author, share``: lines of each author within a symbol over its span."""
    s = symbols.where("start_line is not null and end_line is not null").select(F.col("id").alias("symbol_id"), "file_path", "start_line", "end_line")
    # bins of lines, so that one file is not one group
    bin_of = (F.col("line") / BIN_LINES).cast("int").alias("_bin")
    j = lines.where("line is not null").select("*", bin_of).join(_bins(s, "start_line", "end_line"), ["file_path", "_bin"]).where("line between start_line and end_line")
    span = F.first("end_line") - F.first("start_line") + 1
    return j.groupBy("symbol_id", "author").agg((F.count_distinct("line") / span).alias("share"))


def context(edges: DataFrame, k: int = 5) -> DataFrame:
    """``id, direction, type, n, examples``: what stands around each node, by direction and type."""
    e = edges.where("src is not null and dst is not null")
    out = e.select(F.col("src").alias("id"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    into = e.select(F.col("dst").alias("id"), F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    return grouped_examples(out.unionByName(into).distinct(), ["id", "direction", "type"], "other", k)


def enriched(nodes: DataFrame, edges: DataFrame, repos: DataFrame) -> DataFrame:
    """``id, language, repo_group, n_callers, is_test``: a callable with signals of its file, repository and callers."""
    calls = edges.where((F.col("type") == "CALLS") & F.col("dst").isNotNull()).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_callers"))
    group = repos.groupBy("repo_uri").agg(F.min("repo_group").alias("repo_group"))
    files = nodes.where("kind = 'File' and file_path is not null").groupBy("file_path").agg(F.min("language").alias("language"))
    f = nodes.where(F.col("kind").isin("Function", "Method")).select("id", "file_path", "repo_uri")
    return f.join(files, "file_path", "left").join(group, "repo_uri", "left").join(calls, "id", "left").select(
        "id", "language", "repo_group", F.coalesce("n_callers", F.lit(0)).alias("n_callers"), F.coalesce(is_test_path(F.col("file_path")), F.lit(False)).alias("is_test")
    )
