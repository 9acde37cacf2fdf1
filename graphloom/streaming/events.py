"""Structured Streaming over event tables: windows with late data, deduplication and keyed maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_DDL = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once within the time that late rows may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def maintain_counts(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Counts per user in a Parquet folder, maintained batch by batch; a replayed batch overwrites its own version."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        if epoch > 0:
            new = new.unionByName(spark.read.parquet(f"{target}/v={epoch - 1}")).groupBy("user_id").agg(F.sum("n").alias("n"))
        new.write.mode("overwrite").parquet(f"{target}/v={epoch}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
