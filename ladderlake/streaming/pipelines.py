"""The incremental behaviours of the warehouse as Structured Streaming pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlake.operators.warehouse import latest_per


def stream_table(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def dedupe(events: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Content-addressed intake: each key once within the watermark, so state stays bounded."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Counts and sums per window and kind."""
    win = F.window(at, width)
    return events.withWatermark(at, delay).groupBy(win.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    win = F.session_window(at, gap)
    return events.withWatermark(at, delay).groupBy(win.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def memory(events: DataFrame, key: str, at: str) -> DataFrame:
    """First seen, last seen and times seen per key; an idempotent state for update mode."""
    return events.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))


def upsert_writer(path: str, keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer where the last write per key wins; a batch that is run again gives the same table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        merged = batch
        if batch_id:
            merged = batch.sparkSession.read.parquet(f"{path}/g{batch_id - 1}").unionByName(batch)
        latest_per(merged, keys, [F.desc(order)]).write.mode("overwrite").parquet(f"{path}/g{batch_id}")

    return write
