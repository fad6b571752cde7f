"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.session import stored

#: Rows of one group that one task may number.
HOT_ROWS = 5_000_000


def place_within(rows: DataFrame, group: str, order: list[Column], name: str = "place", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with their place in their group by ``order``, which must be total; null is a group of its own.

    Groups of up to ``hot_rows`` rows are numbered in a window.  Where a group is
    larger, all rows are sorted by range instead, numbered through by range,
    and a group's first number is taken off, so that no task gets a whole group.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= hot_rows:
        return rows.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    spark = rows.sparkSession
    by = [F.asc_nulls_first(group), *order]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-largest // hot_rows) * 2)
    ranged = stored(rows.repartitionByRange(parts, *by).withColumn("__range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("__range").count().orderBy("__range").collect():  # a row a range
        offsets.append((r["__range"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "__range int, __offset bigint"))
    numbered = stored(ranged.join(starts, "__range").withColumn("__n", F.col("__offset") + F.row_number().over(W.partitionBy("__range").orderBy(*by))).drop("__range", "__offset"))
    first = numbered.groupBy(F.col(group).alias("__g")).agg(F.min("__n").alias("__first"))
    placed = numbered.join(first, F.col(group).eqNullSafe(F.col("__g")))
    return placed.withColumn(name, (F.col("__n") - F.col("__first") + 1).cast("int")).drop("__g", "__n", "__first")
