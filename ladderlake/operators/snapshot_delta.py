"""What changed between full snapshots.

The last snapshot of every board lives in one index, bucketed and sorted by key:
key, a 128-bit hash of the values, and the values.  A new snapshot is bucketed in
the same way and probes the index bucket by bucket without moving it; old values
are fetched only for keys whose hashes differ; then the delivered boards' new
entries take the place of their old ones.  A history is driven through the index
date by date.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.session import shared_checkpoint_dir

PLACE, VALUE = ("server", "alliance"), ("name", "power")
STATE = [*PLACE, *VALUE]
#: Boards whose dates are sent to every task at most; beyond that they are joined by shuffle.
BROADCAST_BOARDS = 100_000
HEADS = "board string, generation int, taken_on date, before int, from_date date"
CHANGES = "board string, from_date date, to_date date, identifier string, difference_type string, payload struct<old: struct<name: string, server: int, alliance: string, power: double>, new: struct<name: string, server: int, alliance: string, power: double>>"


def _blank_is_null(name: str) -> Column:
    return F.when(F.trim(F.col(name)) == "", None).otherwise(F.col(name))


def canonical_values(rows: DataFrame) -> DataFrame:
    """Blank and null alliances are equal, and so are powers after rounding to six decimals.

    Of rows that repeat one identifier within a delivery the greatest counts,
    value by value in the order name, server, alliance, power.
    """
    slim = rows.select(
        "board", "taken_on", "identifier", "name", F.col("server").cast("int").alias("server"), _blank_is_null("alliance").alias("alliance"), F.round(F.col("power").cast("double"), 6).alias("power")
    )
    return slim.groupBy("board", "taken_on", "identifier").agg(F.max(F.struct("name", "server", "alliance", "power")).alias("v")).select("board", "taken_on", "identifier", "v.*")


def canonical_values_with_seq(kept: DataFrame) -> DataFrame:
    """The same values row by row, repeated identifiers included, with the number of the date."""
    return kept.select("board", "seq", "identifier", "name", "server", _blank_is_null("alliance").alias("alliance"), F.round("power", 6).alias("power"))


def last_deliveries(deliveries: DataFrame) -> DataFrame:
    """``(board, taken_on, delivery_id, seq)``: of each board and date the delivery received last; ``seq`` numbers a board's dates."""
    heads = deliveries.groupBy("board", "taken_on", "delivery_id").agg(F.max("received_at").alias("received_at"))
    best = heads.groupBy("board", "taken_on").agg(
        F.max(F.struct(F.coalesce("received_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "delivery_id")).alias("m")
    )
    w = W.partitionBy("board").orderBy("taken_on")
    return best.select("board", "taken_on", F.col("m.delivery_id").alias("delivery_id"), F.row_number().over(w).alias("seq"))


class SnapshotIndex:
    """One bucketed index on disk, in which every board's last snapshot is replaced by its next.

    ``path`` must be a folder that all executors share.  Entries are bucketed
    and sorted by (board, key) in ``buckets`` buckets and partitioned by the
    generation that wrote them; a small table tells the generation and date of
    every board's last snapshot.  Boards that are not in a delivery keep their
    entries.  Partitions that no board needs any more are deleted.  An index
    may be opened again by another session.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        layout = f"{self.path}/layout"
        if self._exists(layout):
            self.buckets = spark.read.json(layout).first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).coalesce(1).write.mode("overwrite").json(layout)

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._hadoop(path))

    def _generations(self) -> list[int]:
        """Generations that were applied completely and are still kept."""
        if not self._exists(f"{self.path}/applied"):
            return []
        return sorted(int(f.getPath().getName()[1:]) for f in self._fs.listStatus(self._hadoop(f"{self.path}/applied")) if f.getPath().getName().startswith("g"))

    def _entries(self, generation: int) -> DataFrame:
        """Entries that one generation wrote, known to Spark as bucketed."""
        folder = f"{self.path}/entries/g{generation}"
        name = "ladderlake_index_" + hashlib.md5(folder.encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} (board STRING, key STRING, h1 BIGINT, h2 BIGINT, identifier STRING, name STRING, server INT, alliance STRING, power DOUBLE) "
                f"USING parquet CLUSTERED BY (board, key) SORTED BY (board, key) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
            )
        return self.spark.table(name)

    def _write(self, rows: DataFrame, generation: int) -> None:
        keyed = canonical_values(rows).withColumn("key", F.coalesce(F.concat(F.lit("="), "identifier"), F.lit("")))  # null is an identifier of its own
        state = [F.col(c) for c in ("name", "server", "alliance", "power")]
        # a null field counts by its place, which the hash alone would pass over
        marks = F.concat(*[c.isNull().cast("string") for c in state])
        flat = keyed.select("board", "key", F.xxhash64(marks, *state).alias("h1"), F.xxhash64(F.lit(1), *state, marks).alias("h2"), "identifier", "name", "server", "alliance", "power")
        folder = f"{self.path}/entries/g{generation}"
        name = "ladderlake_write_" + hashlib.md5(folder.encode()).hexdigest()
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        flat.repartition(self.buckets, "board", "key").write.mode("overwrite").option("path", folder).bucketBy(self.buckets, "board", "key").sortBy("board", "key").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # an external table: its files stay

    def apply(self, rows: DataFrame) -> DataFrame:
        """Differences of delivered snapshots (one date a board) against the index; afterwards they are the index.

        A board's first snapshot has no differences.  The result is read from
        the written changes, so it may be used after further deliveries.
        """
        known = self._generations()
        last, generation = (known[-1] if known else 0), (known[-1] + 1 if known else 1)
        self._write(rows, generation)
        new, heads, target = self._entries(generation), f"{self.path}/heads/g{generation}", f"{self.path}/changes/g{generation}"
        dates = rows.groupBy("board").agg(F.max("taken_on").alias("to_date"))
        if last:
            before = self.spark.read.schema(HEADS).parquet(f"{self.path}/heads/g{last}").select("board", F.col("generation").alias("before"), F.col("taken_on").alias("from_date"))
        else:
            before = dates.limit(0).select("board", F.lit(0).alias("before"), F.col("to_date").alias("from_date"))
        both, now = dates.join(before, "board", "full"), F.col("to_date").isNotNull()
        both.select(
            "board", F.when(now, F.lit(generation)).otherwise(F.col("before")).alias("generation"), F.coalesce("to_date", "from_date").alias("taken_on"),
            F.when(now, F.col("before")).alias("before"), F.when(now, F.col("from_date")).alias("from_date"),
        ).write.mode("overwrite").parquet(heads)
        state = self.spark.read.schema(HEADS).parquet(heads)
        counts = state.groupBy("generation", "before").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each two generations in use
        olds = sorted((r["before"], r["n"]) for r in counts if r["before"] is not None)
        for k, (g, n) in enumerate(olds):
            due = state.where(F.col("before") == g).select("board", "from_date", F.col("taken_on").alias("to_date"))
            due = F.broadcast(due) if n <= BROADCAST_BOARDS else due
            self._probe(new, self._entries(g), due).write.mode("append" if k else "overwrite").parquet(target)
        self._fs.create(self._hadoop(f"{self.path}/applied/g{generation}"), True).close()
        self._forget({r["generation"] for r in counts})
        return self.spark.read.schema(CHANGES).parquet(target) if olds else self.spark.createDataFrame([], CHANGES)

    def _probe(self, new: DataFrame, old: DataFrame, due: DataFrame) -> DataFrame:
        """Changes of the boards ``due`` between two generations; both are bucketed alike, so neither is moved."""
        of = lambda df: df.join(due.select("board"), "board", "left_semi")
        slim = lambda df, p: of(df.select("board", "key", F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2")))
        changed = slim(new, "n").join(slim(old, "o"), ["board", "key"], "full").where("not (n1 <=> o1 and n2 <=> o2)").select("board", "key")
        value = F.struct("name", "server", "alliance", "power")
        fetch = lambda df, p: df.select("board", "key", F.col("identifier").alias(f"{p}_identifier"), value.alias(p))
        pair = changed.join(fetch(old, "old"), ["board", "key"], "left").join(fetch(new, "new"), ["board", "key"], "left").join(due, "board")
        same = lambda names: F.expr(" and ".join(f"old.{x} <=> new.{x}" for x in names))
        kind = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").when(~same(PLACE), "Moved").when(~same(VALUE), "Modified")
        return pair.select(
            "board", "from_date", "to_date", F.coalesce("new_identifier", "old_identifier").alias("identifier"), kind.alias("difference_type"), F.struct("old", "new").alias("payload")
        ).where("difference_type is not null")

    def drop(self) -> None:
        """Delete the index; written changes stay."""
        self._forget(set(), keep_last=False)
        for folder in ("heads", "entries", "applied", "layout"):
            self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)

    def _forget(self, needed: set[int], keep_last: bool = True) -> None:
        """Delete entries that no board needs, and tables of heads but the last."""
        known = self._generations()
        for g in known[:-1] if keep_last else known:
            if g not in needed:
                self._fs.delete(self._hadoop(f"{self.path}/entries/g{g}"), True)
                self.spark.sql("DROP TABLE IF EXISTS ladderlake_index_" + hashlib.md5(f"{self.path}/entries/g{g}".encode()).hexdigest())
            self._fs.delete(self._hadoop(f"{self.path}/heads/g{g}"), True)
            if g not in needed:
                self._fs.delete(self._hadoop(f"{self.path}/applied/g{g}"), True)


def diff_series(deliveries: DataFrame, buckets: int | None = None) -> DataFrame:
    """Differences between neighbouring dates of every board.

    Columns: board, from_date, to_date ('yyyy-MM-dd'), identifier,
    difference_type ('Added', 'Removed', 'Moved', 'Modified') and payload, a
    struct of old and new name, server, alliance and power.  The n-th dates of
    all boards are applied to one :class:`SnapshotIndex` together, one after the
    other.  Identifiers are compared as delivered, null being an identifier of
    its own.  The first date of a board has no differences.  Rows without board
    or date are left out, further columns are ignored, empty input gives no rows.
    """
    spark = deliveries.sparkSession
    folder = f"{shared_checkpoint_dir(spark).rstrip('/')}/snapshots-{uuid.uuid4().hex}"
    slim = deliveries.select("delivery_id", "board", "taken_on", "received_at", "identifier", "name", "server", "alliance", "power").where(
        "board is not null and taken_on is not null"
    )
    kept = slim.join(last_deliveries(slim), ["board", "taken_on", "delivery_id"]).select("board", "taken_on", "identifier", "name", "server", "alliance", "power", "seq")
    kept.repartition("seq", "board").write.partitionBy("seq").parquet(f"{folder}/delivered")
    delivered = spark.read.schema(kept.schema).parquet(f"{folder}/delivered")
    dates = sorted(r["seq"] for r in delivered.select("seq").distinct().collect())  # a number a date
    index = SnapshotIndex(spark, f"{folder}/index", buckets)
    for n in dates:
        index.apply(delivered.where(F.col("seq") == n).drop("seq"))
    index.drop()
    index._fs.delete(index._hadoop(f"{folder}/delivered"), True)
    changes = spark.read.schema(CHANGES).parquet(*[f"{folder}/index/changes/g{n}" for n in range(2, len(dates) + 1)]) if len(dates) > 1 else spark.createDataFrame([], CHANGES)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return changes.select("board", day("from_date"), day("to_date"), "identifier", "difference_type", "payload")


def differences_at_once(deliveries: DataFrame) -> DataFrame:
    """The rows of :func:`diff_series` in one plan, for queries that go over a whole history anyway.

    Every delivered row meets the one before it under (board, identifier, number
    of the date) in a single shuffle; equal states are left out after it.
    """
    slim = deliveries.select("delivery_id", "board", "taken_on", "received_at", "identifier", "name", "server", "alliance", "power").where(
        "board is not null and taken_on is not null"
    )
    chosen = last_deliveries(slim)
    rows = canonical_values(slim.join(chosen, ["board", "taken_on", "delivery_id"])).join(chosen.select("board", "taken_on", "seq"), ["board", "taken_on"])
    value = F.struct("name", "server", "alliance", "power")
    here = F.explode(F.array(F.struct(F.col("seq").alias("seq"), F.lit(True).alias("new")), F.struct((F.col("seq") + 1).alias("seq"), F.lit(False).alias("new"))))
    met = rows.select("board", "identifier", value.alias("v"), here.alias("at")).groupBy("board", "identifier", F.col("at.seq").alias("seq")).agg(
        F.max(F.when(~F.col("at.new"), F.col("v"))).alias("old"), F.max(F.when(F.col("at.new"), F.col("v"))).alias("new")
    )
    dates = chosen.select("board", "seq", F.col("taken_on").alias("to_date"), F.lag("taken_on").over(W.partitionBy("board").orderBy("taken_on")).alias("from_date")).where("from_date is not null")
    same = lambda names: F.expr(" and ".join(f"old.{x} <=> new.{x}" for x in names))
    kind = F.when(F.col("old").isNull(), "Added").when(F.col("new").isNull(), "Removed").when(~same(PLACE), "Moved").when(~same(VALUE), "Modified")
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return met.join(dates, ["board", "seq"]).select("board", day("from_date"), day("to_date"), "identifier", kind.alias("difference_type"), F.struct("old", "new").alias("payload")).where("difference_type is not null")
