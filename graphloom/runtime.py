"""Session-level plumbing shared by every operator: table access, durable staging and bounded broadcasts.

Long iterative operators cut their lineage by writing a table below the folder that the cluster
names in ``spark.checkpoint.dir``.  All executors share that folder, so losing an executor never
loses a stage.  Only when the setting is absent (tests, a laptop) a temporary folder is chosen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read lazily so that filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: ``spark.checkpoint.dir``, or a local folder where that is unset."""
    configured = spark.conf.get(_CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(_CHECKPOINT_CONF)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_CHECKPOINT_CONF} to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graphloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(_CHECKPOINT_CONF, f"file://{made}")
    return f"file://{made}"


class Staging:
    """A private folder of written tables below the shared folder, one per operator call."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex[:12]}"
        self.written = 0
        _STAGED.add(self.root)

    def cut(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Writes ``df`` once and returns the table that was written."""
        path = f"{self.root}/{self.written:03d}-{name}"
        self.written += 1
        writer = df.write.mode("overwrite")
        if by:
            writer = writer.partitionBy(*by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clean(self) -> None:
        """Deletes the tables of this call; only once nothing lazy reads them any more."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _STAGED.discard(self.root)


_STAGED: set[str] = set()


def clean_staging(spark: SparkSession) -> int:
    """Deletes every staged table of this process; call it once all results are written."""
    roots = list(_STAGED)
    for root in roots:
        at = spark._jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _STAGED.discard(root)
    return len(roots)


def small(df: DataFrame, limit: int, what: str) -> list:
    """Collects a table whose size has a stated bound and refuses a larger one."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows; raise the bound or use the joined form")
    return rows
