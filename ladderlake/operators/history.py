"""History of changing entity attributes.

Updates become a change log per attribute; every attribute has intervals of its
own, and a version is what holds between two neighbouring boundaries of the
union of all attributes' boundaries.  Equal neighbours are coalesced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN = "9999-12-31"


def latest_per_day(updates: DataFrame, key: list[str], day: str, received: str, tie: str, values: list[str], ended: Column) -> DataFrame:
    """One row per key and date, that of the row received last.

    Combined on the map side, so a key with a third of all rows reaches one
    task with at most one row per date and map task.  Ties in ``received`` fall
    to the largest ``tie``; a null ``received`` is earlier than any time.
    """
    payload = F.struct(
        F.coalesce(F.col(received), F.lit("0001-01-01").cast("timestamp")).alias("at"),
        F.col(tie).alias("tie"),
        ended.alias("ended"),
        F.struct(*[F.col(v) for v in values]).alias("state"),
    )
    return (
        updates.where(F.col(day).isNotNull())
        .groupBy(*key, F.col(day).alias("day"))
        .agg(F.max(payload).alias("last"))
        .select(*key, "day", F.coalesce("last.ended", F.lit(False)).alias("ended"), "last.state")
    )


def attribute_intervals(daily: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``(key…, attribute, valid_from, valid_to, value)`` for each attribute by itself; open intervals end at null.

    An end is an event of every attribute.  Values are held as JSON-free
    strings; null is a value.
    """
    log = daily.select(
        *key, "day", "ended", F.explode(F.array(*[F.struct(F.lit(v).alias("attribute"), F.col(f"state.{v}").cast("string").alias("value")) for v in values])).alias("a")
    ).select(*key, "day", "ended", "a.attribute", "a.value")
    w = W.partitionBy(*key, "attribute").orderBy("day")
    event = F.struct("ended", F.when(~F.col("ended"), F.col("value")).alias("value"))
    changes = (
        log.withColumn("event", event)
        .withColumn("before", F.lag("event").over(w))
        .where(F.when(F.col("before").isNull(), ~F.col("ended")).otherwise(~F.col("event").eqNullSafe(F.col("before"))))
    )
    return (
        changes.withColumn("valid_to", F.lead("day").over(w))
        .where(~F.col("ended"))
        .select(*key, "attribute", F.col("day").alias("valid_from"), "valid_to", "value")
    )


def combine_intervals(intervals: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Split at the union of all boundaries, fill every attribute, coalesce equal neighbours.

    The rows of one key are at most its dates times the attributes, so no
    window here is larger than that.
    """
    begun = intervals.select(*key, F.col("valid_from").alias("day"), "attribute", F.struct(F.lit(True).alias("live"), F.col("value")).alias("state"))
    ended = intervals.where("valid_to is not null").select(
        *key, F.col("valid_to").alias("day"), "attribute", F.struct(F.lit(False).alias("live"), F.lit(None).cast("string").alias("value")).alias("state")
    )
    # where one interval ends and the next begins on one day, the beginning holds
    points = (
        begun.unionByName(ended)
        .groupBy(*key, "day")
        .agg(*[F.max(F.when(F.col("attribute") == v, F.col("state"))).alias(v) for v in values])
    )
    w = W.partitionBy(*key).orderBy("day")
    filled = points.select(*key, "day", *[F.last(v, ignorenulls=True).over(w).alias(v) for v in values])
    version = F.struct(*[F.col(v) for v in values])
    steps = (
        filled.withColumn("version", version)
        .withColumn("before", F.lag("version").over(w))
        .where(F.col("before").isNull() | ~F.col("version").eqNullSafe(F.col("before")))
    )
    return (
        steps.withColumn("until", F.lead("day").over(w))
        .where(" or ".join(f"coalesce({v}.live, false)" for v in values))
        .select(*key, *[F.col(f"{v}.value").alias(v) for v in values], F.col("day").alias("from_day"), "until")
    )


def attribute_history(
    updates: DataFrame,
    key: list[str],
    day: str,
    received: str,
    tie: str,
    values: list[str],
    ended: Column | None = None,
) -> DataFrame:
    """Versions ``(key…, values…, valid_from, valid_to)`` with dates as 'yyyy-MM-dd' strings.

    ``valid_to`` is the date of the next change or end and '9999-12-31' while
    open.  Defined results: a null value is a state of its own; a null key
    value is a key of its own; rows without a date are left out; an end without
    a version changes nothing; a state that returns after an end is a new
    version; repeated rows change nothing; empty input gives no rows.
    """
    source = updates.select(
        *[F.col(f"`{c}`") for c in dict.fromkeys([*key, day, received, tie, *values])],
        (F.lit(False) if ended is None else F.coalesce(ended, F.lit(False))).alias("__ended"),
    )
    daily = latest_per_day(source, key, day, received, tie, values, F.col("__ended"))
    versions = combine_intervals(attribute_intervals(daily, key, values), key, values)
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return versions.select(
        *key, *values, text("from_day").alias("valid_from"), F.coalesce(text("until"), F.lit(OPEN)).alias("valid_to")
    )
