"""The store: tables of a graph as Parquet folders, replaced or upserted by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.graph_tables import merge_edges, merge_nodes


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key ``new`` does not have."""
    return old.join(new.select(*key).distinct(), key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def changed(rows: DataFrame, stored: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Rows whose key and digest are not stored yet: what an expensive step still has to do."""
    return rows.join(stored.select(*key, digest).distinct(), [*key, digest], "left_anti")


class GraphStore:
    """One folder per version and table; a pointer file swaps to a finished version."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def version(self) -> str | None:
        fs, p = self._fs(f"{self.root}/_current")
        return self.spark.read.text(f"{self.root}/_current").first()[0] if fs.exists(p) else None

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.version()}/{table}")

    def bulk_load(self, nodes: DataFrame, edges: DataFrame, mode: str = "replace") -> dict[str, int]:
        """Loads merged nodes (by kind) and edges (by type); returns the stored counts."""
        nodes, edges = merge_nodes(nodes), merge_edges(edges)
        if mode == "upsert" and self.version():
            nodes, edges = upsert(self.read("nodes"), nodes, ["id"]), upsert(self.read("edges"), edges, ["id"])
        v = uuid.uuid4().hex[:12]
        # one kind may hold a third of all nodes: its rows stay spread over the tasks that have them
        nodes.write.partitionBy("kind").parquet(f"{self.root}/{v}/nodes")
        edges.write.partitionBy("type").parquet(f"{self.root}/{v}/edges")
        self.spark.createDataFrame([(v,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_current")
        return {"nodes": self.read("nodes").count(), "edges": self.read("edges").count()}


def meta(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The one-row description of a store: schema version and counts."""
    return nodes.sparkSession.createDataFrame([("1.2.0", nodes.count(), edges.count())], "schema_version string, node_count long, edge_count long")
