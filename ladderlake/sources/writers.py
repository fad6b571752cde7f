"""Sinks: partitioned exports, upserts into a folder of Parquet, revisions, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlake.operators.warehouse import latest_per


def export_lanes(rows: DataFrame, path: str) -> None:
    """One folder per server and ranking type, as a workbook has one sheet for each."""
    rows.repartition("server", "ranking_type").write.mode("overwrite").partitionBy("server", "ranking_type").parquet(path)


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, keys: list[str], order: str, generation: int) -> str:
    """Last write wins per key; the merged table is a new generation beside the old one, so a failed write loses nothing."""
    merged = updates
    if generation:
        merged = spark.read.parquet(f"{path}/g{generation}").unionByName(updates)
    target = f"{path}/g{generation + 1}"
    latest_per(merged, keys, [F.desc(order)]).write.mode("overwrite").parquet(target)
    return target


def save_revision(rows: DataFrame, path: str, mode: str, revision: int) -> int:
    """Save modes of a snapshot: 'skip' keeps what is there, 'replace' overwrites it, 'revision' adds the next one."""
    if mode == "skip" and revision:
        return revision
    number = revision if mode == "replace" and revision else revision + 1
    rows.withColumn("revision", F.lit(number)).write.mode("overwrite").parquet(f"{path}/r{number}")
    return number


def json_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
