"""Character evidence and event windows as named queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.operators import evidence as ev
from ladderlake.operators.ranks import place_within
from ladderlake.plans.base import Book, Frames
from ladderlake.sources import readers

B = Book()
K = ev.PLACE
_K = ", ".join(K)
_OBS = f"""WITH f AS (SELECT DISTINCT server, captured_on, slot, fragment_id, raw_player_name AS text, CAST(round(coalesce(confidence, 0.5) * 100) AS BIGINT) AS cp FROM fragments WHERE regexp_matches(raw_player_name, '[\\p{{L}}\\p{{N}}]')),
o AS (SELECT {_K}, fragment_id, pos, text[pos] AS ch, cp FROM (SELECT *, unnest(range(1, length(text) + 1)) AS pos FROM f)),
v AS (SELECT {_K}, pos, ch, count(*) AS n, sum(cp) AS points FROM o GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {_K}, pos) AS BIGINT) AS total, count(*) OVER (PARTITION BY {_K}, pos) AS chars, row_number() OVER (PARTITION BY {_K}, pos ORDER BY n DESC, points DESC, ch) AS place_no FROM v),
l AS (SELECT {_K}, length, count(*) AS k FROM (SELECT {_K}, fragment_id, max(pos) AS length FROM o GROUP BY ALL) GROUP BY ALL),
u AS (SELECT {_K}, length AS usual_length FROM l QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY k DESC, length DESC) = 1),
p0 AS (SELECT r.* EXCLUDE (place_no), usual_length, {ev.SHARE} AS share, {ev.MEAN} AS mean_confidence FROM r JOIN u USING ({_K}) WHERE place_no = 1),
p AS (SELECT *, {ev.CONSENSUS} AS consensus, {ev.RISK} AS risk, {ev.MAP} AS state, {ev.STAGE} AS failed_stage, {ev.BRIDGE} AS bridge FROM p0),
g0 AS (SELECT {_K}, count(*) AS positions, count(*) FILTER (WHERE state = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE state = 'CONFLICT') AS conflicts, min(share) AS weakest, sum(CAST(round(consensus * 10000) AS BIGINT)) AS c, string_agg(ch, '' ORDER BY pos) AS composed FROM p GROUP BY ALL),
g1 AS (SELECT * EXCLUDE (c), round(confirmed::DOUBLE / positions, 4) AS coverage, round(c::DOUBLE / positions / 10000, 4) AS mean_consensus FROM g0),
g AS (SELECT *, {ev.CLEARANCE} AS clearance, {ev.READINESS} AS readiness FROM g1)
"""


def pos(f: Frames):
    return ev.positions(ev.observations(f.t("fragments")))


def place(f: Frames):
    return ev.places(pos(f))


def add(name, build, sql):
    B.add(name, build)
    B.sql[name] = _OBS + sql


def of(name, frame, table, columns, extra=None, where=None):
    extra = extra or {}
    more = "".join(f", {e} AS {a}" for a, e in extra.items())
    add(name, lambda f: (frame(f).where(where) if where else frame(f)).select(*K, *columns, *[F.expr(e).alias(a) for a, e in extra.items()]), f"SELECT {_K}{''.join(', ' + c for c in columns)}{more} FROM {table}" + (f" WHERE {where}" if where else ""))


add("debug_flatten", lambda f: ev.observations(f.t("fragments")).select("fragment_id", "pos", "ch"), "SELECT fragment_id, pos, ch FROM o")
of("vote_select", pos, "p", ["pos", "ch", "n", "total"])
of("acquisition_consensus", pos, "p", ["pos", "consensus"], {"class": ev.CONSENSUS_CLASS})
of("position_risk", pos, "p", ["pos", "risk"], {"class": ev.RISK_CLASS})
of("position_evidence_map", pos, "p", ["pos", "state"])
of("position_provenance", pos, "p", ["pos", "failed_stage"])
of("position_bridge", pos, "p", ["pos", "bridge"])
of("crop_anchor_class", pos, "p", ["pos"], {"anchor": "CASE WHEN pos > usual_length THEN 'outside' WHEN pos = 1 THEN 'start' WHEN pos = usual_length THEN 'end' ELSE 'inside' END"})
of("identity_composition", place, "g", ["composed", "coverage"])
of("display_reconstruct", place, "g", ["composed"], where="conflicts = 0")
of("blocker_clearance", place, "g", ["conflicts", "clearance"])
of("readiness", place, "g", ["coverage", "mean_consensus", "readiness"])
of("name_proof", place, "g", [], {"proof": "CASE WHEN confirmed = positions THEN 'SOURCE_EXACT' WHEN coverage >= 0.75 THEN 'MOSTLY_PROVEN' WHEN confirmed > 0 THEN 'PARTLY_PROVEN' ELSE 'INSUFFICIENT_EVIDENCE' END"})
of("review_confidence", place, "g", [], {"confidence": "round(0.25e0 * coverage + 0.25e0 * weakest + 0.30e0 * mean_consensus + 0.20e0 * CASE WHEN conflicts = 0 THEN 1 ELSE 0 END + 1e-9, 4)"})
of("alignment_guard", place, "g", [], {"lane": "CASE WHEN mean_consensus >= 0.90 THEN 'read_only' WHEN conflicts > 0 THEN 'guarded' ELSE 'open' END"})
of("row_evidence_status", place, "g", [], {"status": "CASE WHEN conflicts > 0 THEN 'CONFLICT' WHEN coverage >= 1 THEN 'COMPLETE' ELSE 'PARTIAL' END"})
add("acquisition_heatmap", lambda f: pos(f).groupBy("pos").agg(F.count("*").alias("places"), F.count_if(F.col("state") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("state") == "CONFLICT").alias("conflicts")), "SELECT pos, count(*) AS places, count(*) FILTER (WHERE state = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE state = 'CONFLICT') AS conflicts FROM p GROUP BY 1")
add("evidence_summary", lambda f: place(f).groupBy("server").agg(F.count("*").alias("places"), F.count_if(F.col("readiness") == "READY").alias("ready"), F.sum("conflicts").alias("conflicts")), "SELECT server, count(*) AS places, count(*) FILTER (WHERE readiness = 'READY') AS ready, CAST(sum(conflicts) AS BIGINT) AS conflicts FROM g GROUP BY 1")
add("scheduler", lambda f: place_within(place(f), "server", [F.desc("conflicts"), F.col("mean_consensus"), F.col("captured_on"), F.col("slot")], "queue").select(*K, "queue"), f"SELECT {_K}, row_number() OVER (PARTITION BY server ORDER BY conflicts DESC, mean_consensus, captured_on, slot) AS queue FROM g")
add("evidence_budget", lambda f: place(f).withColumn("spent", F.sum("positions").over(W.partitionBy("server").orderBy(F.desc("conflicts"), "mean_consensus", "captured_on", "slot").rowsBetween(W.unboundedPreceding, 0))).where("spent <= 500").select(*K, "spent"),
    f"SELECT {_K}, spent FROM (SELECT *, CAST(sum(positions) OVER (PARTITION BY server ORDER BY conflicts DESC, mean_consensus, captured_on, slot ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM g) WHERE spent <= 500")
add("fragment_confidence", lambda f: ev.observations(f.t("fragments")).join(pos(f).select(*K, "pos", F.col("ch").alias("best")), [*K, "pos"]).groupBy("fragment_id").agg(F.round(F.sum((F.col("ch") == F.col("best")).cast("int")) / F.count("*"), 4).alias("agreement")),
    f"SELECT fragment_id, round(sum(CAST(o.ch = p.ch AS INT))::DOUBLE / count(*), 4) AS agreement FROM o JOIN p USING ({_K}, pos) GROUP BY 1")
_COMP = "CASE WHEN ch IN (' ', '_', '-', '.') THEN 'SEPARATOR' WHEN ch IN ('[', ']') THEN 'BRACKET' WHEN ch IN ('★', '…', '?') THEN 'DECORATIVE_MARK' ELSE 'NAME_TOKEN' END"
of("identity_components", pos, "p", ["pos"], {"component": _COMP})
add("identity_graph", lambda f: pos(f).where("state = 'CONFLICT'").select(*K, F.concat(F.lit("char:"), F.col("pos").cast("string")).alias("source"), F.expr(f"concat('component:', {_COMP})").alias("target")), f"SELECT {_K}, 'char:' || pos AS source, 'component:' || {_COMP} AS target FROM p WHERE state = 'CONFLICT'")


def add_plain(name, build, sql):
    B.add(name, build)
    B.sql[name] = sql


add_plain("quarantine_join", lambda f: f.entries.where("lane like '%quarantine' and power > 0").select("row_id", "server", F.floor(F.col("power") / 1000000).alias("m")).join(f.t("player_rankings").select("entry_id", "server", F.floor(F.col("power") / 1000000).alias("m")), ["server", "m"]).select("row_id", "entry_id"),
          "SELECT row_id, entry_id FROM (SELECT DISTINCT row_id, server, power FROM ranking_rows WHERE lane LIKE '%quarantine' AND power > 0) q JOIN player_rankings p ON q.server = p.server AND q.power // 1000000 = p.power // 1000000")
add_plain("cross_server_join", lambda f: f.t("sheet_players").select("sheet_row_id", "server", "thp", F.lower("player").alias("key")).join(f.t("player_rankings").select("entry_id", F.col("server").alias("other"), F.col("power").alias("thp"), F.lower("player_name").alias("key")), ["key", "thp"]).where("server <> other").select("sheet_row_id", "entry_id"),
          "SELECT sheet_row_id, entry_id FROM sheet_players s JOIN player_rankings p ON lower(player) = lower(player_name) AND thp = power AND s.server <> p.server")
add_plain("event_tumbling", lambda f: f.t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n"),
          "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
add_plain("event_memory", lambda f: f.t("events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("times_seen")),
          "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS times_seen FROM events GROUP BY 1")
add_plain("src_wide_metrics", lambda f: readers.wide_metrics(f.t("city_stats").select("id", "city_level_1", "city_level_2", "city_level_3", "influence_points").distinct(), ["id"]),
          "SELECT id, metric_name, value FROM (SELECT DISTINCT id, CAST(city_level_1 AS BIGINT) AS city_level_1, CAST(city_level_2 AS BIGINT) AS city_level_2, CAST(city_level_3 AS BIGINT) AS city_level_3, influence_points FROM city_stats) UNPIVOT (value FOR metric_name IN (city_level_1, city_level_2, city_level_3, influence_points))")

QUERIES, SQL = B.queries, B.sql
