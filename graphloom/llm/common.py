"""Shared pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(columns: list[str]) -> Column:
    """How many of the columns hold a value in this row: the richer of two deliveries wins."""
    return sum((F.col(f"`{c}`").isNotNull().cast("int") for c in columns), F.lit(0))


def file_rows(nodes: DataFrame, *more: str) -> DataFrame:
    """File rows with an id: ``id, file_path, content, rank`` and ``more``, one per delivery.

    ``rank`` orders the deliveries of an id.  Operators work per delivery and merge their *results*
    by rank, so that no file text ever enters an exchange.
    """
    every = [c for c in nodes.columns if c != "id"]
    rank = F.struct(filled(every).alias("n"), F.xxhash64(*[F.col(f"`{c}`") for c in every if c != "content"]).alias("h"))
    return nodes.where((F.col("kind") == "File") & F.col("id").isNotNull()).select(
        "id", "file_path", "content", rank.alias("rank"), *more
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores: a few large row groups would leave most idle.

    An input of many splits, as on a large cluster, stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
