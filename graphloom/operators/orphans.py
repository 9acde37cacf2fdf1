"""References to records that do not exist at the time of the reference.

The plan never moves the wide fact rows for keys that are in order:

1. the foreign keys are reduced to *distinct* keys with the span of reference times (partial
   aggregation, so a key that holds a third of all rows leaves each task as one row);
2. the distinct keys are anti-joined against the parent keys whose life covers all their references:
   a key goes on only if it has no parent, or if some reference lies outside the parent's life;
3. the fact rows are joined back to the suspicious keys only, and tested row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: External symbols are a fixed reference list; above this many rows they are joined instead of broadcast.
EXTERNAL_BOUND = 100_000


def parent_lives(nodes: DataFrame) -> DataFrame:
    """``key, born, died`` per node id: earliest arrival, removal of the row with more non-null fields."""
    every = [c for c in nodes.columns if c != "id"]
    n = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in every), F.lit(0))
    # a struct maximum keeps the removal that belongs to the richer row; max() skips no field
    rank = F.struct(n.alias("n"), F.col("removed_at").isNotNull().alias("f"), F.col("removed_at").alias("r"))
    return (
        nodes.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("key"))
        .agg(F.min("indexed_at").alias("born"), F.max(rank)["r"].alias("died"), F.lit(True).alias("known"))
    )


def _references(edges: DataFrame) -> DataFrame:
    ends = F.array(
        F.struct(F.lit("src").alias("endpoint"), F.col("src").alias("key")),
        F.struct(F.lit("dst").alias("endpoint"), F.col("dst").alias("key")),
    )
    return edges.select("id", "type", "indexed_at", F.explode(ends).alias("e")).select(
        F.col("id").alias("edge_id"), "type", F.col("indexed_at").alias("at"), "e.endpoint", "e.key"
    ).where(F.col("key").isNotNull())


def orphan_references(edges: DataFrame, nodes: DataFrame, external: DataFrame) -> DataFrame:
    """``edge_id, endpoint, key, type, at, cause`` for each reference without a parent at its time.

    ``cause`` is ``missing`` (no such id), ``early`` (the parent arrives later) or ``removed`` (the
    parent was gone).  Null keys are no references.  A null reference time or a null birth cannot be
    compared: such a reference is an orphan only if the id is missing.  Ids compare byte for byte.
    Repeated rows of an edge give one row per distinct content.  Empty tables give an empty result;
    an empty ``nodes`` makes every reference an orphan unless ``external`` has it.
    """
    spark = edges.sparkSession
    refs = _references(edges)
    ext = external.select(F.col("id").alias("key")).where(F.col("key").isNotNull()).distinct()
    bounded = ext.limit(EXTERNAL_BOUND + 1).count() <= EXTERNAL_BOUND
    if bounded:
        # references to the outside never enter an exchange, however hot one of them is
        refs = refs.join(F.broadcast(ext), "key", "left_anti")

    keys = refs.groupBy("key").agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count(F.lit(1)).alias("n_refs")
    )
    if not bounded:
        keys = keys.join(ext, "key", "left_anti")
    lives = parent_lives(nodes)
    covers = (
        (F.col("k.key") == F.col("p.key"))
        & (F.col("k.first_at") >= F.col("p.born"))
        & (F.col("p.died").isNull() | (F.col("k.last_at") < F.col("p.died")))
    )
    suspects = keys.alias("k").join(lives.alias("p"), covers, "left_anti").select("key")
    suspects = suspects.join(lives, "key", "left")
    return (
        refs.join(suspects, "key")
        .withColumn(
            "cause",
            F.when(F.col("known").isNull(), "missing").when(F.col("at") < F.col("born"), "early").when(F.col("at") >= F.col("died"), "removed"),
        )
        .where("cause is not null")
        .select("edge_id", "endpoint", "key", "type", "at", "cause")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references per edge type, side and month of the reference (null month for a null time)."""
    return (
        orphans.select("edge_id", "endpoint", "type", F.date_format("at", "yyyy-MM").alias("month"), "cause")
        .groupBy("type", "endpoint", "month")
        .agg(
            F.count(F.lit(1)).alias("n_orphans"),
            F.count_if(F.col("cause") == "missing").alias("n_missing"),
            F.count_if(F.col("cause") == "early").alias("n_early"),
            F.count_if(F.col("cause") == "removed").alias("n_removed"),
        )
    )
