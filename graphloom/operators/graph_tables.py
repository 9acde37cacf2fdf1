"""Delivery rules of the graph tables: merging repeated nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(columns: list[str]) -> Column:
    """How many of the columns hold a value in this row."""
    return sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))


def merge_nodes(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per node id: the row with more non-null fields, with the earliest ``indexed_at`` as arrival.

    A tie goes to the earlier ``indexed_at``, then to a fixed order of the rows' contents.  Rows without an id are dropped, because
    nothing can refer to them.  ``keep`` prunes the columns that leave (and enter) the exchange.
    """
    keep = keep or nodes.columns
    every = [c for c in nodes.columns if c != "id"]
    kept = [c for c in keep if c not in ("id", "indexed_at")]
    ranked = nodes.where(F.col("id").isNotNull()).select(
        "id",
        filled(every).alias("_n"),
        F.xxhash64(*[F.col(f"`{c}`") for c in every if c != "content"]).alias("_h"),
        *(["indexed_at", (-F.unix_micros(F.col("indexed_at").cast("timestamp"))).alias("_t")] if "indexed_at" in nodes.columns else []),
        *[F.col(f"`{c}`") for c in kept],
    )
    aggs = [F.max_by(F.struct(*[F.col(f"`{c}`") for c in kept]), F.struct("_n", *(["_t"] if "indexed_at" in nodes.columns else []), "_h")).alias("_row")] if kept else []
    if "indexed_at" in nodes.columns:
        aggs.append(F.min("indexed_at").alias("indexed_at"))
    if not aggs:
        return ranked.select("id").distinct()
    merged = ranked.groupBy("id").agg(*aggs)
    out = merged.select(
        "id",
        *(["indexed_at"] if "indexed_at" in nodes.columns else []),
        *[F.col(f"_row.`{c}`").alias(c) for c in kept],
    )
    return out.select(*[F.col(f"`{c}`") for c in keep if c in out.columns])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id: the higher confidence wins (null lowest), then the earlier ``loaded_at``.

    Source, target and type are part of an id, so they are keys of the aggregation: filters on them reach
    the scan, and every other column is an aggregate of its own, which leaves the plan where nobody asks
    for it.  What remains for most queries is a fixed-width partial aggregate.  Rows without an id are
    dropped; should the ends of an id differ, each pair of ends keeps a row.
    """
    early = -F.unix_micros(F.col("loaded_at").cast("timestamp"))
    order = F.struct("confidence", early)
    keys = ["id", "src", "dst", "type"]
    rest = [c for c in edges.columns if c not in (*keys, "confidence")]
    one = edges.where(F.col("id").isNotNull()).groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), *[F.max_by(F.struct(F.col(f"`{c}`")), order).getField(c).alias(c) for c in rest]
    )
    return one.select(*[F.col(f"`{c}`") for c in edges.columns])
