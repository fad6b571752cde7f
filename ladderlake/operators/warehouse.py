"""Star-schema queries, coverage, sinks and set operations of the ranking warehouse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order``, which must be total."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """Top-N per group; Spark limits each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Last write wins per key over both frames."""
    return latest_per(base.unionByName(updates), keys, order)


def get_or_create(dimension: DataFrame, wanted: DataFrame, natural: list[str]) -> DataFrame:
    """The dimension with rows for unseen natural keys; keys are hashes, so no counter is shared."""
    key = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in natural]), 256)
    have = dimension.select(*natural).distinct()
    on = None
    left = wanted.select(*natural).distinct().alias("l")
    for c in natural:
        e = F.coalesce(F.col(f"l.{c}"), F.lit("")).eqNullSafe(F.coalesce(F.col(f"r.{c}"), F.lit("")))
        on = e if on is None else on & e
    fresh = left.join(have.alias("r"), on, "left_anti")
    return have.withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True))).withColumn("key", key)


def delete_cascade(parents: DataFrame, doomed: DataFrame, children: DataFrame, parent_id: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children that survive the deletion of ``doomed`` parents."""
    gone = doomed.select(F.col(parent_id).alias("__gone")).distinct()
    return (
        parents.join(gone, F.col(parent_id) == F.col("__gone"), "left_anti"),
        children.join(gone, F.col(ref) == F.col("__gone"), "left_anti"),
    )


def vote_majority(votes: DataFrame, keys: list[str], value: str, first_at: str) -> DataFrame:
    """Most frequent value per key; ties fall to the value seen first."""
    counted = votes.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votes"), F.min(first_at).alias("first_at"))
    return latest_per(counted, keys, [F.desc("votes"), F.col("first_at"), F.col(value)])


def gap_islands(found: DataFrame, last_rank: int | None = None) -> DataFrame:
    """Runs of missing ranks per snapshot and ranking type with the ranks on both sides, up to ``last_rank`` or the last rank there is.

    ``found``: snapshot_id, ranking_type, rank.  Only neighbours are compared,
    so a window never holds more than the ranks of one list.
    """
    w = W.partitionBy("snapshot_id", "ranking_type").orderBy("rank")
    seen = found.where("rank >= 1" if last_rank is None else F.col("rank").between(1, last_rank)).distinct()
    inner = seen.withColumn("previous", F.lag("rank").over(w)).withColumn("next", F.lead("rank").over(w))
    before = inner.where(F.col("rank") - F.coalesce("previous", F.lit(0)) > 1).select(
        "snapshot_id", "ranking_type", (F.coalesce("previous", F.lit(0)) + 1).alias("gap_start"), (F.col("rank") - 1).alias("gap_end"),
        F.col("previous").alias("previous_anchor"), F.col("rank").alias("next_anchor"),
    )
    if last_rank is not None:
        tail = inner.where(F.col("next").isNull() & (F.col("rank") < last_rank)).select(
            "snapshot_id", "ranking_type", (F.col("rank") + 1).alias("gap_start"), F.lit(last_rank).alias("gap_end"),
            F.col("rank").alias("previous_anchor"), F.lit(None).cast("int").alias("next_anchor"),
        )
        before = before.unionByName(tail)
    return before.withColumn("gap_rows", F.col("gap_end") - F.col("gap_start") + 1).withColumn(
        "bounded", F.col("previous_anchor").isNotNull() & F.col("next_anchor").isNotNull()
    )


def required_ranks(found: DataFrame, keys: list[str], required: int) -> DataFrame:
    """Missing ranks out of 1..required and completeness in percent."""
    have = found.where(F.col("rank").between(1, required)).groupBy(*keys).agg(F.collect_set("rank").alias("have"))  # at most `required` values
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1), F.lit(required)), F.col("have").cast("array<int>")))
    return have.select(
        *keys, F.size("have").alias("found_ranks"), F.concat_ws(",", F.transform(missing, lambda x: x.cast("string"))).alias("missing_ranks"),
        F.round(F.size("have") * 100.0 / required, 2).alias("completeness"),
    )


def step_changes(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Difference and percent change against the step before; a step from zero has none."""
    w = W.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    return series.withColumn("previous", before).withColumn("change", F.col(value) - F.col("previous")).withColumn(
        "percent", F.when(F.col("previous") != 0, F.round((F.col(value) - F.col("previous")) * 100.0 / F.col("previous"), 4))
    )
