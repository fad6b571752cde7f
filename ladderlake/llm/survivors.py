"""Best representative of each duplicate group.

Field by field the most trusted value survives: highest confidence first, then
the most current.  Every group is a partial order of its contending values:
timestamps order the values that have one, and where a contender has none,
currency is reasoned.  The timestamped rows of all groups teach which value
follows which, what follows a successor follows as well, and a value that no
other value of its group follows is topologically latest.  Where all contenders
have a timestamp the order is total, and its last value is a maximum.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.session import stored

def text_value(column: Column) -> Column:
    """Null where a text says nothing: no letter or digit, 'n/a' or 'null' in any case."""
    says = column.rlike(r"[\p{L}\p{N}]") & ~F.lower(F.trim(column)).isin("n/a", "null")
    return F.when(says, column)


def positive_value(column: Column) -> Column:
    return F.when(column > 0, column)


def contenders(rows: DataFrame, group: list[str], fields: Mapping[str, Column], row_id: str, trust: str, at: str) -> DataFrame:
    """One row per row and field with a value: (group…, field, value, trust, at, row_id)."""
    trust_value = F.coalesce(F.nanvl(F.col(f"`{trust}`").cast("double"), F.lit(None).cast("double")), F.lit(float("-inf")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), c.cast("string").alias("value")) for f, c in fields.items()])
    return (
        rows.select(
            *[F.col(f"`{g}`") for g in group], F.col(f"`{row_id}`").alias("row_id"), trust_value.alias("trust"), F.col(f"`{at}`").alias("at"), F.explode(cells).alias("cell")
        )
        .select(*group, "row_id", "trust", "at", "cell.field", "cell.value")
        .where("value is not null")
    )


def _same(group: list[str], left: str, right: str) -> Column:
    """The group keys and the field of two frames are equal, null being a key of its own."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in [*group, "field"]])


def successions(cells: DataFrame, group: list[str]) -> DataFrame:
    """(field, value, later): values of a group and field, and those that were first seen 1, 2, 4, 8, … places after them.

    The doubling distances let :func:`followers` cross a list of any length in a
    few steps.  The values of all groups are sorted by range and numbered
    through, and meet by number, so that a group of any size is spread over
    tasks.  Values first seen at one instant have no order.
    """
    spark, key = cells.sparkSession, [*group, "field", "first_at", "value"]
    values = cells.where("at is not null").groupBy(*group, "field", "value").agg(F.min("at").alias("first_at"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(values.repartitionByRange(parts, *key).withColumn("range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranged.groupBy("range").count().orderBy("range").collect():  # a row a range
        offsets.append((r["range"], before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(offsets, "range int, offset bigint"))
    place = F.row_number().over(W.partitionBy("range").orderBy(*[F.asc_nulls_first(c) for c in key]))
    numbered = stored(ranged.join(starts, "range").withColumn("pos", F.col("offset") + place).select(*key, "pos"))
    ends = numbered.groupBy(*group, "field").agg(F.max("pos").alias("end"))
    listed = numbered.alias("n").join(ends.alias("e"), _same(group, "n", "e")).where("end > pos").select("n.field", "n.value", "n.first_at", "pos", "end")
    jumps = listed.withColumn("jump", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("end") - F.col("pos"))).cast("int"))))
    jumps = jumps.select("field", "value", "first_at", (F.col("pos") + F.expr("shiftleft(1L, jump)")).alias("target"))
    return jumps.join(numbered.select(F.col("pos").alias("target"), F.col("value").alias("later"), F.col("first_at").alias("later_at")), "target").where("later_at > first_at").select("field", "value", "later")


def learn_precedence(cells: DataFrame, group: list[str]) -> DataFrame:
    """(field, earlier, later): value pairs of which the first was followed by the second in more groups than the other way round."""
    low, high = F.least("value", "later"), F.greatest("value", "later")
    votes = successions(cells, group).groupBy("field", low.alias("low"), high.alias("high")).agg(F.sum(F.when(F.col("value") == low, 1).otherwise(-1)).alias("net"))
    return votes.where("net <> 0").select(
        "field", F.when(F.col("net") > 0, F.col("low")).otherwise(F.col("high")).alias("earlier"), F.when(F.col("net") > 0, F.col("high")).otherwise(F.col("low")).alias("later")
    )


def followers(origins: DataFrame, precedence: DataFrame) -> DataFrame:
    """(field, value, later): everything that follows an origin (field, value) over any number of steps."""
    edges = stored(precedence.select(F.col("field").alias("f"), "earlier", F.col("later").alias("onward")))
    known = reached = stored(origins.join(edges, (F.col("field") == F.col("f")) & (F.col("value") == F.col("earlier"))).select("field", "value", F.col("onward").alias("later")).distinct())
    while not reached.isEmpty():
        onward = reached.join(edges, (F.col("field") == F.col("f")) & (F.col("later") == F.col("earlier"))).select("field", "value", F.col("onward").alias("later")).distinct()
        reached = stored(onward.join(known, ["field", "value", "later"], "left_anti"))
        known = known.unionByName(reached)
    return known


def best_values(cells: DataFrame, group: list[str]) -> DataFrame:
    """(group…, field, row_id, value) of the surviving contender.

    One aggregation, combined on the map side, settles every group whose most
    trusted contenders all have a timestamp, so a group may hold any part of
    the rows.  Ties fall to the smallest row_id.  Groups with a most trusted
    contender without timestamp are settled by the partial order; values that
    follow each other in a circle have no order.  Where several values are
    latest, a timestamp wins, then the smallest row_id.
    """
    pick = lambda *first: F.max(F.struct(*first, "at", (-F.col("row_id")).alias("minus_id"), "value"))
    settled = cells.groupBy(*group, "field").agg(
        pick("trust").alias("best"), F.max(F.struct("trust", F.col("at").isNull().alias("undated"))).alias("open")
    )
    out = [*group, "field", (-F.col("best.minus_id")).alias("row_id"), F.col("best.value").alias("value")]
    unsure = settled.where("open.undated").select(*group, "field", F.col("open.trust").alias("top"))
    if unsure.isEmpty():
        return settled.select(*out)
    rivals = cells.alias("c").join(unsure.alias("u"), _same(group, "c", "u") & (F.col("c.trust") == F.col("u.top"))).select("c.*")
    nodes = stored(rivals.groupBy(*group, "field", "value").agg(F.max(F.struct("at", (-F.col("row_id")).alias("minus_id"))).alias("latest")))
    after = followers(nodes.select("field", "value").distinct(), learn_precedence(cells, group))
    back = after.select("field", F.col("later").alias("value"), F.col("value").alias("later"))
    strict = after.join(back, ["field", "value", "later"], "left_anti")
    led = nodes.join(strict, ["field", "value"]).select(*group, "field", "value", "later", F.col("latest.at").alias("at"))
    passed = led.alias("a").join(nodes.alias("b"), _same(group, "a", "b") & (F.col("a.later") == F.col("b.value")) & (F.col("a.at").isNull() | F.col("b.latest.at").isNull()))
    passed = passed.select("a.*").select(*group, "field", "value").distinct()
    open_nodes = nodes.alias("a").join(passed.alias("b"), _same(group, "a", "b") & (F.col("a.value") == F.col("b.value")), "left_anti")
    reasoned = open_nodes.groupBy(*group, "field").agg(F.max(F.struct(F.col("latest.at").alias("at"), F.col("latest.minus_id").alias("minus_id"), "value")).alias("best"))
    return settled.where("not open.undated").select(*out).unionByName(reasoned.select(*out))


def survivors(rows: DataFrame, group: list[str], fields: Mapping[str, Column], row_id: str, trust: str, at: str) -> DataFrame:
    """One row per group of more than one row: for each field ``<field>`` (as text) and ``<field>_from``, the row it comes from.

    Defined results: a null or NaN trust is the lowest; a group of one row id
    is no duplicate group and does not come out, however often the row is
    repeated; a field without any value is null in both columns; null group
    keys form groups of their own; further columns are ignored; empty input
    gives no rows.
    """
    several = rows.groupBy(*[F.col(f"`{g}`") for g in group]).agg(F.min(f"`{row_id}`").alias("lo"), F.max(f"`{row_id}`").alias("hi")).where("lo < hi").select(*group)
    best = best_values(contenders(rows, group, fields, row_id, trust, at), group)
    wide = best.groupBy(*[F.col(g).alias(f"b_{g}") for g in group]).agg(
        *[x for f in fields for x in (F.max(F.when(F.col("field") == f, F.col("value"))).alias(f), F.max(F.when(F.col("field") == f, F.col("row_id"))).alias(f"{f}_from"))]
    )
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"b_{g}"))
    return several.join(wide, on, "left").select(*group, *[x for f in fields for x in (f, f"{f}_from")])
