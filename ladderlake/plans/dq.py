"""Queries of the general data-quality problems (orphans, history, spikes, snapshot changes)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlake.operators.control_chart import flag_readings
from ladderlake.operators.history import attribute_history
from ladderlake.operators.orphans import orphan_references, orphan_report
from ladderlake.operators.snapshot_delta import diff_series
from ladderlake.session import table

FIELDS = ["power", "hero_power", "alliance_power"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    of_collections = orphan_references(
        [("snapshots", t("snapshots"), "id", "collection_id"), ("pact_entries", t("pact_entries"), "id", "collection_id")], t("collections")
    )
    of_snapshots = orphan_references(
        [("metrics", t("metrics"), "id", "snapshot_id"), ("city_stats", t("city_stats"), "id", "snapshot_id")], t("snapshots")
    )
    return of_collections.unionByName(of_snapshots)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p3_found(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_versions(spark, sf_dir).select("record_kind", "record_key", "valid_from", "valid_to")


def p4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = attribute_history(
        table(spark, sf_dir, "entity_updates"), ["entity_id"], "effective_on", "received_at", "update_id", ["tag", "name"], F.col("change_kind") == "retire"
    )
    targets = attribute_history(
        table(spark, sf_dir, "recruitment_targets"), ["server", "name"], "board_date", "received_at", "target_row_id", ["alliance"]
    )
    none = F.lit(None).cast("string")
    return entities.select(
        F.lit("entity").alias("record_kind"), F.col("entity_id").cast("string").alias("record_key"), "tag", "name", none.alias("alliance"), "valid_from", "valid_to"
    ).unionByName(
        targets.select(
            F.lit("target").alias("record_kind"), F.concat_ws("|", F.col("server").cast("string"), "name").alias("record_key"),
            none.alias("tag"), none.alias("name"), "alliance", "valid_from", "valid_to",
        )
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_readings(table(spark, sf_dir, "ranking_rows"), FIELDS, "power").select("row_id", "field_name")


def p7_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diff_series(table(spark, sf_dir, "candidate_snapshots"))
    flat = [F.col(f"payload.{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("name", "server", "alliance", "power")]
    return d.select("board", "from_date", "to_date", "identifier", "difference_type", *flat)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_series(table(spark, sf_dir, "candidate_snapshots")).drop("payload")


QUERIES = {
    "p3_found": p3_found, "p3_report": p3_report, "p4_found": p4_found, "p4_versions": p4_versions,
    "p5_found": p5_found, "p7_found": p7_found, "p7_differences": p7_differences,
}

_P3 = """
WITH c AS (SELECT id, bool_or(lower(trim(status)) = 'deleted') AS deleted, min(created_at) AS born FROM collections GROUP BY id),
     s AS (SELECT id, bool_or(lower(trim(status)) = 'deleted') AS deleted, min(created_at) AS born FROM snapshots GROUP BY id),
     r AS (
  SELECT 'snapshots' AS table_name, x.id AS row_id, x.created_at, p.id AS pid, p.deleted, p.born FROM snapshots x LEFT JOIN c p ON x.collection_id = p.id WHERE x.collection_id IS NOT NULL
  UNION ALL SELECT 'pact_entries', x.id, x.created_at, p.id, p.deleted, p.born FROM pact_entries x LEFT JOIN c p ON x.collection_id = p.id WHERE x.collection_id IS NOT NULL
  UNION ALL SELECT 'metrics', x.id, x.created_at, p.id, p.deleted, p.born FROM metrics x LEFT JOIN s p ON x.snapshot_id = p.id WHERE x.snapshot_id IS NOT NULL
  UNION ALL SELECT 'city_stats', x.id, x.created_at, p.id, p.deleted, p.born FROM city_stats x LEFT JOIN s p ON x.snapshot_id = p.id WHERE x.snapshot_id IS NOT NULL),
     f AS (SELECT DISTINCT table_name, row_id,
       CASE WHEN pid IS NULL THEN 'missing' WHEN deleted THEN 'deleted' WHEN born > created_at THEN 'late' END AS kind,
       strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM r)
"""

_P4 = """
WITH e AS (
  SELECT 'entity' AS record_kind, CAST(entity_id AS VARCHAR) AS record_key, tag, name, NULL::VARCHAR AS alliance, effective_on AS day,
         change_kind = 'retire' AS ended, received_at, update_id AS tie FROM entity_updates WHERE effective_on IS NOT NULL
  UNION ALL
  SELECT 'target', concat_ws('|', CAST(server AS VARCHAR), name), NULL, NULL, alliance, board_date, false, received_at, target_row_id FROM recruitment_targets WHERE board_date IS NOT NULL),
  l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY record_kind, record_key, day ORDER BY received_at DESC NULLS LAST, tie DESC) = 1),
  p AS (SELECT *, lag(ended) OVER w AS b_ended, lag(tag) OVER w AS b_tag, lag(name) OVER w AS b_name, lag(alliance) OVER w AS b_alliance FROM l
        WINDOW w AS (PARTITION BY record_kind, record_key ORDER BY day)),
  c AS (SELECT * FROM p WHERE (b_ended IS NULL AND NOT ended) OR (b_ended IS NOT NULL AND (ended <> b_ended
        OR (NOT ended AND (tag IS DISTINCT FROM b_tag OR name IS DISTINCT FROM b_name OR alliance IS DISTINCT FROM b_alliance))))),
  v AS (SELECT *, lead(day) OVER (PARTITION BY record_kind, record_key ORDER BY day) AS until FROM c)
"""
_P4_DATES = "strftime(day, '%Y-%m-%d') AS valid_from, coalesce(strftime(until, '%Y-%m-%d'), '9999-12-31') AS valid_to FROM v WHERE NOT ended"

_P7 = """
WITH h AS (SELECT board, taken_on, delivery_id, max(received_at) AS got FROM candidate_snapshots WHERE board IS NOT NULL AND taken_on IS NOT NULL GROUP BY ALL),
  k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY board, taken_on ORDER BY got DESC NULLS LAST, delivery_id DESC) = 1),
  q AS (SELECT board, taken_on, delivery_id, row_number() OVER (PARTITION BY board ORDER BY taken_on) AS seq, lag(taken_on) OVER (PARTITION BY board ORDER BY taken_on) AS from_date FROM k),
  r AS (SELECT DISTINCT q.board, q.seq, c.identifier, c.name, c.server, nullif(trim(c.alliance), '') AS alliance0, CASE WHEN trim(c.alliance) = '' THEN NULL ELSE c.alliance END AS alliance, round(c.power, 6) AS power
        FROM candidate_snapshots c JOIN q USING (board, taken_on, delivery_id)),
  n AS (SELECT q.board, q.from_date, q.taken_on AS to_date, r.* EXCLUDE (board) FROM q JOIN r ON r.board = q.board AND r.seq = q.seq WHERE q.from_date IS NOT NULL),
  o AS (SELECT q.board, q.from_date, q.taken_on AS to_date, r.* EXCLUDE (board) FROM q JOIN r ON r.board = q.board AND r.seq = q.seq - 1 WHERE q.from_date IS NOT NULL),
  j AS (SELECT coalesce(n.board, o.board) AS board, coalesce(n.from_date, o.from_date) AS f, coalesce(n.to_date, o.to_date) AS t, coalesce(n.identifier, o.identifier) AS identifier,
        CASE WHEN o.board IS NULL THEN 'Added' WHEN n.board IS NULL THEN 'Removed'
             WHEN n.server IS DISTINCT FROM o.server OR n.alliance IS DISTINCT FROM o.alliance THEN 'Moved'
             WHEN n.name IS DISTINCT FROM o.name OR n.power IS DISTINCT FROM o.power THEN 'Modified' END AS difference_type,
        o.name AS old_name, o.server AS old_server, o.alliance AS old_alliance, o.power AS old_power,
        n.name AS new_name, n.server AS new_server, n.alliance AS new_alliance, n.power AS new_power
        FROM n FULL JOIN o ON n.board = o.board AND n.to_date = o.to_date AND n.identifier IS NOT DISTINCT FROM o.identifier)
"""
_P7_HEAD = "board, strftime(f, '%Y-%m-%d') AS from_date, strftime(t, '%Y-%m-%d') AS to_date, identifier, difference_type"

_P5 = """
WITH d AS (SELECT DISTINCT row_id, source_file, rank, captured_at, power, hero_power, alliance_power FROM ranking_rows),
  m AS (SELECT source_file, median(ch) AS habit FROM (
     SELECT source_file, abs(power - b)::DOUBLE / b AS ch FROM (
       SELECT source_file, power, lag(power) OVER (PARTITION BY source_file, rank ORDER BY captured_at, row_id) AS b FROM d WHERE power > 0)
     WHERE b IS NOT NULL AND b <> power) GROUP BY source_file),
  l AS (SELECT row_id, source_file, rank, captured_at, 'power' AS field_name, power AS x FROM d WHERE power IS NOT NULL
     UNION ALL SELECT row_id, source_file, rank, captured_at, 'hero_power', hero_power FROM d WHERE hero_power IS NOT NULL
     UNION ALL SELECT row_id, source_file, rank, captured_at, 'alliance_power', alliance_power FROM d WHERE alliance_power IS NOT NULL),
  w AS (SELECT *, lag(x) OVER o AS b1, lag(x, 2) OVER o AS b2, lag(x, 3) OVER o AS b3, lead(x) OVER o AS a1, lead(x, 2) OVER o AS a2, lead(x, 3) OVER o AS a3 FROM l
     WINDOW o AS (PARTITION BY source_file, rank, field_name ORDER BY captured_at, row_id)),
  y AS (SELECT w.*, habit, list_median(list_filter([b1, b2, b3], lambda e: e IS NOT NULL)) AS mb, list_median(list_filter([a1, a2, a3], lambda e: e IS NOT NULL)) AS ma,
     x = b1 AS s0, b1 = b2 AS s1, b2 = b3 AS s2, x = a1 AS t1, a1 = a2 AS t2
     FROM w LEFT JOIN m ON w.source_file IS NOT DISTINCT FROM m.source_file)
SELECT row_id, field_name FROM y WHERE x <= 0
  OR coalesce(s0 AND ((s1 AND s2) OR (s1 AND t1) OR (t1 AND t2)), false)
  OR coalesce((mb IS NOT NULL OR ma IS NOT NULL) AND (mb IS NULL OR abs(x - mb) > 12 * habit * abs(mb)) AND (ma IS NULL OR abs(x - ma) > 12 * habit * abs(ma)), false)
"""

SQL = {
    "p3_found": _P3 + "SELECT * FROM f WHERE kind IS NOT NULL",
    "p3_report": _P3 + "SELECT table_name, period, kind, count(*) AS orphans FROM f WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _P4 + "SELECT record_kind, record_key, " + _P4_DATES,
    "p4_versions": _P4 + "SELECT record_kind, record_key, tag, name, alliance, " + _P4_DATES,
    "p5_found": _P5,
    "p7_found": _P7 + f"SELECT {_P7_HEAD} FROM j WHERE difference_type IS NOT NULL",
    "p7_differences": _P7 + f"SELECT {_P7_HEAD}, old_name, old_server, old_alliance, old_power, new_name, new_server, new_alliance, new_power FROM j WHERE difference_type IS NOT NULL",
}
