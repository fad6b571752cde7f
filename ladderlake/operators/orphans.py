"""References to records that do not exist.

Keys become integers (a dictionary where they are not integers already).  The
references of every child table and the parents are stored as bitmaps of 64
bits, one word per key range of 64 and period, words without a set bit being
left out, so that a bitmap is never larger than its distinct keys.  The answer
is ``reference AND NOT parent`` per word; only the surviving bits are decoded
and looked at row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderlake.session import cut

#: A surviving key is repeated under this many salts before it meets the rows
#: again, so that one key with a third of all rows is spread over many tasks.
SALTS = 16


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(code, F.lit(64)).cast("int"))


def _word(code: Column) -> Column:
    return F.shiftright(code, 6)


def key_dictionary(keys: DataFrame, column: str) -> DataFrame:
    """``(key, code)`` with codes that are dense inside each range of sorted keys.

    Only used where keys are not integers.  The dictionary is written to the
    shared checkpoint folder, because the codes depend on the partitioning.
    """
    distinct = keys.select(F.col(column).alias("key")).where(F.col("key").isNotNull()).distinct()
    return cut(distinct.sort("key").withColumn("code", F.monotonically_increasing_id()))


def parent_words(parents: DataFrame) -> DataFrame:
    """``(word, alive)``: per key range the bits of the parents that are not deleted, by month of creation.

    ``alive`` has at most 64 entries, as a parent sets one bit in one month.
    """
    live = parents.where(~F.col("deleted"))
    monthly = live.groupBy(_word(F.col("code")).alias("word"), F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        F.bit_or(_bit(F.col("code"))).alias("bits")
    )
    return monthly.groupBy("word").agg(F.collect_list(F.struct("month", "bits")).alias("alive"))


def reference_words(refs: DataFrame) -> DataFrame:
    """``(table_name, period, word, bits)`` of the references, combined on the map side before the shuffle."""
    return refs.groupBy("table_name", "period", _word(F.col("code")).alias("word")).agg(F.bit_or(_bit(F.col("code"))).alias("bits"))


def surviving_keys(ref_words: DataFrame, par_words: DataFrame) -> DataFrame:
    """Decode ``reference AND NOT parents created before the period``.

    A parent created within the period itself may be younger or older than a
    row, so it counts as absent here and is compared exactly afterwards.
    """
    before = F.aggregate(
        F.filter("alive", lambda x: x["month"] < F.col("period")),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc.bitwiseOR(x["bits"]),
    )
    left = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(before, F.lit(0).cast("bigint"))))
    bits = ref_words.join(par_words, "word", "left").select("table_name", "period", "word", left.alias("left_bits")).where("left_bits <> 0")
    position = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("left_bits").bitwiseAND(_bit(i)) != 0))
    return bits.select("table_name", "period", "word", position.alias("position")).select(
        "table_name", "period", (F.shiftleft(F.col("word"), 6) + F.col("position")).alias("code")
    )


def orphan_references(
    children: list[tuple[str, DataFrame, str, str]],
    parents: DataFrame,
    parent_id: str = "id",
    status: str = "status",
    created_at: str = "created_at",
    salts: int = SALTS,
) -> DataFrame:
    """Rows whose parent is missing, deleted or younger than the row.

    ``children`` lists ``(table name, rows, id column, reference column)``; the
    rows also need ``created_at``.  Returns distinct
    ``(table_name, row_id, kind, period)``; ``kind`` is the first that holds of
    'missing', 'deleted' (status 'deleted' in any letter case, blanks at the
    ends ignored) and 'late' (the parent's ``created_at`` lies after the row's).

    Defined results: null references are no references; a row without
    ``created_at`` has a null period and cannot be late; of several rows of one
    parent id the earliest ``created_at`` counts, and it is deleted if one of
    them is; a parent without ``created_at`` is never too young; a parent that
    is itself an orphan is no reason; further columns are ignored; empty inputs
    give no rows.
    """
    refs = reduce(
        DataFrame.unionByName,
        [
            rows.select(
                F.lit(name).alias("table_name"),
                F.col(f"`{row_id}`").alias("row_id"),
                F.col(f"`{ref}`").alias("key"),
                F.col(f"`{created_at}`").alias("row_at"),
                F.date_format(F.col(f"`{created_at}`"), "yyyy-MM").alias("period"),
            )
            for name, rows, row_id, ref in children
        ],
    ).where(F.col("key").isNotNull())
    known = parents.select(
        F.col(f"`{parent_id}`").alias("key"),
        (F.lower(F.trim(F.col(f"`{status}`"))) == "deleted").alias("deleted"),
        F.col(f"`{created_at}`").alias("created_at"),
    ).where(F.col("key").isNotNull())
    known = known.groupBy("key").agg(
        F.coalesce(F.max("deleted"), F.lit(False)).alias("deleted"), F.min("created_at").alias("created_at")
    )
    if dict(refs.dtypes)["key"] in ("bigint", "int", "smallint", "tinyint"):
        refs = refs.withColumn("code", F.col("key").cast("bigint"))
        known = known.withColumn("code", F.col("key").cast("bigint"))
    else:
        codes = key_dictionary(refs.select("key").unionByName(known.select("key")), "key")
        refs = refs.join(codes, "key")
        known = known.join(codes, "key")
    # a parent without created_at counts from the beginning of time
    par = parent_words(known.withColumn("created_at", F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp"))))
    # rows without a period are kept under a word of their own and never masked
    words = reference_words(refs.withColumn("period", F.coalesce("period", F.lit(""))))
    suspects = surviving_keys(words, par).join(known.select("code", "deleted", "created_at"), "code", "left")
    suspects = suspects.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = refs.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int")).withColumn(
        "lookup", F.coalesce("period", F.lit(""))
    )
    hit = salted.join(suspects.withColumnRenamed("period", "lookup"), ["table_name", "lookup", "code", "salt"])
    kind = (
        F.when(F.col("deleted").isNull(), "missing")
        .when(F.col("deleted"), "deleted")
        .when(F.col("created_at") > F.col("row_at"), "late")
    )
    return (
        hit.select("table_name", F.col("row_id").cast("bigint").alias("row_id"), kind.alias("kind"), "period")
        .where(F.col("kind").isNotNull())
        .distinct()
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return found.groupBy("table_name", "period", "kind").agg(F.count(F.lit(1)).alias("orphans"))
