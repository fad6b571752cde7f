"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits decided per round; 12 + 20 + 20 + 12 make up a double's 64 bits.
ROUNDS = ((52, 12), (32, 20), (12, 20), (0, 12))


def grouped_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, median)`` of non-negative doubles, exact, by radix selection.

    A non-negative double orders as its bit pattern does.  Each round counts
    the next digits per group (combined on the map side) and keeps the digit
    that holds the wanted order statistics, so no task ever holds more than
    2**20 counters of a group, however many rows the group has.  The median of
    an even number of values is the mean of the two in the middle.  Null values
    are left out; groups without values give no row.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("__g"), F.col(value).cast("double").alias("__v"))
    bits = F.expr("cast(java_method('java.lang.Double', 'doubleToLongBits', __v) as bigint)")
    rows = rows.select("__g", "__v", bits.alias("__b"))
    counts = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    want = counts.select("__g", F.explode(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2"))).alias("rest")).distinct()
    want = want.select("__g", "rest", F.col("rest").alias("k"), F.lit(0).cast("bigint").alias("prefix"))
    for shift, width in ROUNDS:
        digit = F.shiftright(F.col("__b"), shift).bitwiseAND(F.lit((1 << width) - 1))
        above = F.shiftright(F.col("__b"), shift + width) if shift + width < 64 else F.lit(0).cast("bigint")
        prefixes = want.select("__g", "prefix").distinct()
        tally = (
            rows.withColumn("prefix", above)
            .join(prefixes, ["__g", "prefix"], "left_semi")
            .groupBy("__g", "prefix", digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("c"))
        )
        w = W.partitionBy("__g", "prefix").orderBy("digit")
        upto = tally.withColumn("upto", F.sum("c").over(w))
        want = (
            want.join(upto, ["__g", "prefix"])
            .where("rest < upto and rest >= upto - c")
            .select(
                "__g",
                (F.col("rest") - (F.col("upto") - F.col("c"))).alias("rest"),
                "k",
                F.shiftleft(F.col("prefix"), width).bitwiseOR(F.col("digit")).alias("prefix"),
            )
        )
    values = rows.select("__g", F.col("__b").alias("prefix"), "__v").join(want.select("__g", "prefix").distinct(), ["__g", "prefix"], "left_semi").distinct()
    return (
        want.join(values, ["__g", "prefix"])
        .groupBy("__g")
        .agg(F.avg("__v").alias("median"))
        .select(F.col("__g").alias(group), "median")
    )
