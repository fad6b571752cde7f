"""Canonical frames over the test tables, shared by all named queries, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.session import table

ENTRY_COLUMNS = [
    "row_id", "snapshot_id", "server", "ranking_type", "lane", "source_file", "ocr_rank", "rank", "name", "alliance_tag", "player_name",
    "power", "hero_power", "alliance_power", "server_confidence", "server_warning", "rank_warning", "raw_text", "y", "captured_at",
]

#: Readings from here on are impossible and take no part in standings.
POWER_LIMIT = 10**15


class Frames:
    """Lazily built canonical frames of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def collections(self) -> DataFrame:
        """Collections with their place in time; a fixed, small dimension."""
        return self.t("collections").withColumn("ord", F.row_number().over(W.orderBy("created_at", "id")))

    @cached_property
    def snapshots(self) -> DataFrame:
        """One row per snapshot id: re-sent rows reduced to the latest state, combined on the map side."""
        s = F.struct("updated_at", "status", "collection_id", "server", "created_at", "ocr_engine", "parser_version")
        return self.t("snapshots").groupBy("id").agg(F.max(s).alias("s")).select("id", "s.*")

    @cached_property
    def entries(self) -> DataFrame:
        """Ranking rows without re-sent copies."""
        return self.t("ranking_rows").select(*ENTRY_COLUMNS).dropDuplicates(["row_id"])

    @cached_property
    def star(self) -> DataFrame:
        c = self.collections.select(F.col("id").alias("collection_id"), F.col("name").alias("collection"), F.col("type").alias("collection_type"), "ord")
        s = self.snapshots.select(F.col("id").alias("snapshot_id"), "collection_id", F.col("status").alias("snapshot_status"))
        return self.entries.join(s.join(F.broadcast(c), "collection_id"), "snapshot_id")  # c: 30 rows, fixed

    def timeline(self, ranking_type: str, entity: str) -> DataFrame:
        """(server, ord, collection, entity, value, rank) of the operational lane, one row per entity and collection."""
        rows = self.star.where((F.col("ranking_type") == ranking_type) & (F.col("lane") == "operational") & (F.col("power") > 0) & (F.col("power") < POWER_LIMIT)).select(
            "server", "ord", "collection", F.expr(entity).alias("entity"), "power"
        )
        best = rows.where("entity is not null").groupBy("server", "ord", "collection", "entity").agg(F.max("power").alias("value"))
        return best.withColumn("rank", F.row_number().over(W.partitionBy("server", "ord").orderBy(F.desc("value"), "entity")))

    @cached_property
    def ally(self) -> DataFrame:
        return self.timeline("alliance_power", "coalesce(alliance_tag, name)")

    @cached_property
    def hero(self) -> DataFrame:
        return self.timeline("total_hero_power", "player_name")


BASE = """
coll AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS ord FROM collections),
snap AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, collection_id DESC NULLS LAST) = 1),
ent AS (SELECT DISTINCT """ + ", ".join(ENTRY_COLUMNS) + """ FROM ranking_rows),
star AS (SELECT ent.*, snap.collection_id, snap.status AS snapshot_status, coll.name AS collection, coll.type AS collection_type, coll.ord
  FROM ent JOIN snap ON ent.snapshot_id = snap.id JOIN coll ON snap.collection_id = coll.id),
ally0 AS (SELECT server, ord, collection, coalesce(alliance_tag, name) AS entity, max(power) AS value FROM star
  WHERE ranking_type = 'alliance_power' AND lane = 'operational' AND power > 0 AND power < 1000000000000000 AND coalesce(alliance_tag, name) IS NOT NULL GROUP BY ALL),
ally AS (SELECT *, row_number() OVER (PARTITION BY server, ord ORDER BY value DESC, entity) AS rank FROM ally0),
hero0 AS (SELECT server, ord, collection, player_name AS entity, max(power) AS value FROM star
  WHERE ranking_type = 'total_hero_power' AND lane = 'operational' AND power > 0 AND power < 1000000000000000 AND player_name IS NOT NULL GROUP BY ALL),
hero AS (SELECT *, row_number() OVER (PARTITION BY server, ord ORDER BY value DESC, entity) AS rank FROM hero0)
"""


def with_base(sql: str) -> str:
    """``sql`` may begin with further common table expressions, introduced by a comma."""
    return "WITH " + BASE + sql


class Book:
    """A collection of named queries."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Frames], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, sf_dir: build(Frames(spark, sf_dir))
        if sql is not None:
            self.sql[name] = with_base(sql)
