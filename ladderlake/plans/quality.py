"""Row reconstruction, guards, validation and text functions as named queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions import text as tx
from ladderlake.operators import guards as gd
from ladderlake.operators import rows as rw
from ladderlake.operators import validate as va
from ladderlake.operators.ranks import place_within
from ladderlake.plans.base import Book, Frames

B = Book()
add = B.add


def tokens(f: Frames):
    """Every ranking row as the three tokens of its line on the screen: rank, tag and name, power."""
    base = f.entries.where("y is not null and power is not null").select("row_id", "snapshot_id", "source_file", "y", "rank", "name", "power", "server_confidence")
    box = lambda x1, x2: F.array(*[F.array(F.lit(x), F.col("y") + d) for x, d in ((x1, -8.0), (x2, -8.0), (x2, 8.0), (x1, 8.0))])
    part = lambda n, text, x1, x2: F.struct((F.col("row_id") * 10 + n).alias("token_id"), text.alias("text"), box(x1, x2).alias("box"), F.coalesce("server_confidence", F.lit(0.5)).alias("confidence"))
    cells = F.array(part(1, F.col("rank").cast("string"), 30.0, 60.0), part(2, F.coalesce("name", F.lit("?")), 120.0, 360.0), part(3, F.col("power").cast("string"), 480.0, 620.0))
    return base.select("snapshot_id", "source_file", F.explode(cells).alias("t")).select("snapshot_id", "source_file", "t.*")


def lines(f: Frames):
    return rw.y_islands(rw.token_geometry(tokens(f)))


add("token_geometry", lambda f: rw.token_geometry(tokens(f)).select("token_id", "x1", "x2", F.round("cy", 3).alias("cy")),
    "SELECT row_id * 10 + n AS token_id, CASE n WHEN 1 THEN 30.0::DOUBLE WHEN 2 THEN 120.0 ELSE 480.0 END AS x1, CASE n WHEN 1 THEN 60.0::DOUBLE WHEN 2 THEN 360.0 ELSE 620.0 END AS x2, round(y, 3) AS cy FROM ent, (VALUES (1), (2), (3)) v(n) WHERE y IS NOT NULL AND power IS NOT NULL")
add("token_dedup", lambda f: rw.token_dedup(rw.token_geometry(tokens(f))).groupBy("snapshot_id", "source_file").agg(F.count("*").alias("tokens")))
add("y_cluster", lambda f: lines(f).groupBy("snapshot_id", "source_file").agg(F.max("line").alias("lines")),
    """, k AS (SELECT snapshot_id, source_file, y, coalesce(CAST(y - lag(y) OVER (PARTITION BY snapshot_id, source_file ORDER BY y) > 18 AS INT), 1) AS new FROM (SELECT DISTINCT snapshot_id, source_file, y FROM ent WHERE y IS NOT NULL AND power IS NOT NULL))
    SELECT snapshot_id, source_file, CAST(sum(new) AS BIGINT) AS lines FROM k GROUP BY ALL""")
add("y_cluster_legacy", lambda f: rw.y_clusters(rw.token_geometry(tokens(f))).groupBy("snapshot_id", "source_file").agg(F.max("line").alias("lines")))
add("row_anchor", lambda f: rw.row_anchors(lines(f)).select("snapshot_id", "source_file", "row_no", "power_text", F.round("top", 3).alias("top"), F.round("bottom", 3).alias("bottom")))
add("row_band_assign", lambda f: rw.row_bands(lines(f), rw.row_anchors(lines(f))).select("snapshot_id", "source_file", "row_no", F.size("words").alias("words")))
add("parse_rows", lambda f: rw.parse_rows(rw.row_bands(lines(f), rw.row_anchors(lines(f)))))
add("dedupe_identity_power", lambda f: rw.dedupe_identity_power(f.entries.where("power > 0 and name is not null"), ["snapshot_id"], "name", "power", "row_id"),
    """, k AS (SELECT snapshot_id, name, power, sum(new) OVER (PARTITION BY snapshot_id, name ORDER BY power DESC, row_id) AS island FROM (SELECT *, coalesce(CAST(lag(power) OVER w - power > 0.003 * lag(power) OVER w AS INT), 1) AS new FROM ent WHERE power > 0 AND name IS NOT NULL WINDOW w AS (PARTITION BY snapshot_id, name ORDER BY power DESC, row_id)))
    SELECT snapshot_id, name, max(power) AS power, count(*) AS merged FROM k GROUP BY snapshot_id, name, island""")
add("merge_partial_window", lambda f: f.entries.where("ocr_rank is not null").groupBy("snapshot_id", "ranking_type", "ocr_rank").agg(F.countDistinct("source_file").alias("windows"), F.countDistinct("name").alias("names"), F.max("power").alias("power"))
    .withColumn("state", F.expr("CASE WHEN windows > 1 AND names > 1 THEN 'conflict' ELSE 'locked' END")),
    "SELECT snapshot_id, ranking_type, ocr_rank, count(DISTINCT source_file) AS windows, count(DISTINCT name) AS names, max(power) AS power, CASE WHEN count(DISTINCT source_file) > 1 AND count(DISTINCT name) > 1 THEN 'conflict' ELSE 'locked' END AS state FROM ent WHERE ocr_rank IS NOT NULL GROUP BY ALL")
_MF = "CASE WHEN ocr_rank IS NULL THEN 'inferred' WHEN ocr_rank = inferred THEN 'confirmed' WHEN abs(ocr_rank - inferred) <= 2 THEN 'shifted' ELSE 'conflict' END"
add("merge_full_scope", lambda f: f.entries.where("power > 0").withColumn("inferred", F.row_number().over(W.partitionBy("snapshot_id", "ranking_type").orderBy(F.desc("power"), "row_id"))).where("inferred <= 150").select("row_id", "inferred", F.expr(_MF).alias("status")),
    f"SELECT row_id, inferred, {_MF} AS status FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, ranking_type ORDER BY power DESC, row_id) AS inferred FROM ent WHERE power > 0) WHERE inferred <= 150")
add("ranking_type_infer", lambda f: f.entries.groupBy("snapshot_id", "source_file").agg(F.max("power").alias("m")).select("snapshot_id", "source_file", F.expr("CASE WHEN m > 1000000000 THEN 'alliance_power' ELSE 'total_hero_power' END").alias("inferred")),
    "SELECT snapshot_id, source_file, CASE WHEN max(power) > 1000000000 THEN 'alliance_power' ELSE 'total_hero_power' END AS inferred FROM ent GROUP BY ALL")
_KW = "100 * CAST(source_file LIKE '%ally%' AS INT) + 80 * CAST(source_file LIKE '%thp%' AS INT) + 20 * CAST(source_file LIKE '%hero%' AS INT)"
add("ranking_type_detect", lambda f: f.entries.select("source_file").distinct().withColumn("score", F.expr(_KW)), f"SELECT DISTINCT source_file, {_KW} AS score FROM ent")
add("server_extract", lambda f: f.entries.select("source_file").distinct().withColumn("found", F.regexp_extract("source_file", r"(?:^|s)([0-9]{3,4})[-_@]", 1)).where("found <> ''").select("source_file", F.col("found").cast("int").alias("server")),
    "SELECT DISTINCT source_file, CAST(regexp_extract(source_file, '(?:^|s)([0-9]{3,4})[-_@]', 1) AS INT) AS server FROM ent WHERE regexp_matches(source_file, '(?:^|s)([0-9]{3,4})[-_@]')")
add("player_entries", lambda f: place_within(f.t("player_rankings").select("entry_id", "server", "rank", "power"), "server", [F.desc("power"), F.col("entry_id")]).select("entry_id", "place", F.coalesce("rank", "place").alias("shown_rank")),
    "SELECT entry_id, row_number() OVER (PARTITION BY server ORDER BY power DESC, entry_id) AS place, coalesce(rank, row_number() OVER (PARTITION BY server ORDER BY power DESC, entry_id)) AS shown_rank FROM player_rankings")
add("identity_lock", lambda f: f.entries.select("row_id", F.coalesce("player_name", "name").alias("locked_name")), "SELECT row_id, coalesce(player_name, name) AS locked_name FROM ent")

# --- guards ------------------------------------------------------------------
add("server_assignment", lambda f: gd.server_assignment(f.entries),
    """, v AS (SELECT snapshot_id, CAST(regexp_extract(source_file, '(?:^|s)([0-9]{3,4})[-_@]', 1) AS INT) AS voted, count(*) AS votes FROM ent WHERE regexp_matches(source_file, '(?:^|s)([0-9]{3,4})[-_@]') GROUP BY ALL),
    b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY votes DESC, voted) = 1), m AS (SELECT snapshot_id, min(server) AS server FROM ent GROUP BY 1)
    SELECT m.snapshot_id, server, CASE WHEN votes >= 3 THEN voted ELSE server END AS assigned, coalesce(votes >= 3, false) AS by_vote, CASE WHEN votes >= 3 THEN voted ELSE server END <> server AS conflict FROM m LEFT JOIN b USING (snapshot_id)""")
_FIT = """CASE WHEN ranking_type = 'total_hero_power' THEN 60 * coalesce(power >= 1000000 AND power <= 1000000000, false)::INT + 40 * (player_name IS NOT NULL)::INT
   ELSE 60 * coalesce(power > 1000000000, false)::INT + 40 * (player_name IS NULL)::INT END"""
_JUDGED = "CASE WHEN power IS NULL THEN 'placeholder' WHEN fit < 40 THEN 'quarantine' WHEN fit < 60 THEN 'calibrated_pass' ELSE 'pass' END"
_SANE = """CASE WHEN power IS NULL THEN 'missing' WHEN NOT power > 0 THEN 'quarantine_nonpositive' WHEN median_power > 0 AND rank > 3 AND power / 3::DOUBLE > median_power THEN 'quarantine_high'
   WHEN median_power > 0 AND power * 5::DOUBLE < median_power THEN 'quarantine_low' WHEN power / 1.5::DOUBLE > previous_power THEN 'review_order' ELSE 'pass' END"""
_RISKY = "CASE (rank_warning IS NOT NULL)::INT + (server_warning IS NOT NULL)::INT WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE CASE WHEN name IS NULL THEN 'medium' ELSE 'low' END END"
_SHOWS = "CASE WHEN ocr_rank IS NULL THEN CASE WHEN rank IS NULL THEN 'source_row_only' ELSE 'derived' END WHEN rank IS NOT DISTINCT FROM ocr_rank THEN 'explicit' ELSE 'conflict' END"
add("ranking_guard", lambda f: gd.ranking_guard(f.entries),
    f""", g AS (SELECT *, {_JUDGED} AS verdict FROM (SELECT *, {_FIT} AS fit FROM ent))
    SELECT row_id, fit, verdict, lane AS out_lane, power AS out_power FROM g WHERE verdict <> 'quarantine' UNION ALL SELECT row_id, fit, verdict, 'operational', NULL FROM g WHERE verdict = 'quarantine' UNION ALL SELECT row_id, fit, verdict, 'ranking_guard_quarantine', power FROM g WHERE verdict = 'quarantine'""")
_REC = "CASE WHEN lane = 'ranking_guard_quarantine' AND power > 0 AND rank_warning IS NULL THEN 'recovered' WHEN lane = 'operational' AND rank_warning IS NOT NULL THEN 'calibrated_pass' WHEN lane LIKE '%quarantine' THEN 'quarantine' ELSE 'pass' END"
add("ranking_recovery", lambda f: f.entries.select("row_id", F.expr(_REC).alias("decision")), f"SELECT row_id, {_REC} AS decision FROM ent")
add("power_sanity_rules", lambda f: gd.power_sanity(f.entries).select("row_id", "decision"),
    f"SELECT row_id, {_SANE} AS decision FROM (SELECT *, quantile_cont(power, 0.5) OVER (PARTITION BY snapshot_id, source_file) AS median_power, lag(power) OVER (PARTITION BY snapshot_id, source_file ORDER BY rank, row_id) AS previous_power FROM ent)")
for _n, _t in (("thp_explosion_set", "total_hero_power"), ("alliance_shape_set", "alliance_power")):
    add(_n, lambda f, t=_t: gd.explosion_set(f.entries.where(F.col("ranking_type") == t)),
        f"SELECT row_id, power, most_before FROM (SELECT row_id, power, max(power) OVER (PARTITION BY snapshot_id, source_file ORDER BY rank, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most_before FROM ent WHERE ranking_type = '{_t}' AND power > 0) WHERE power > 2.5 * most_before")
add("power_candidates", lambda f: f.entries.where("lane like '%quarantine' and power > 0").select("row_id", F.explode(gd.power_candidates(F.col("power"))).alias("candidate")),
    """SELECT DISTINCT row_id, candidate FROM (SELECT row_id, power, CAST(power AS VARCHAR) AS s FROM ent WHERE lane LIKE '%quarantine' AND power > 0),
    LATERAL (SELECT unnest(list_concat(list_transform(['0', '00'], lambda d: TRY_CAST(s || d AS BIGINT)), list_concat(list_transform(range(1, length(s) + 1), lambda i: TRY_CAST(s[1:i] || '0' || s[i + 1:] AS BIGINT)), list_transform(['1', '2', '3', '4'], lambda d: TRY_CAST(d || s AS BIGINT))))) AS candidate) WHERE candidate IS NOT NULL""")
add("candidate_scoring", lambda f: gd.power_sanity(f.entries).where("decision like 'quarantine%' and power > 0 and median_power > 0").select("row_id", "power", "median_power", F.explode(gd.power_candidates(F.col("power"))).alias("candidate"))
    .withColumn("kept", tx.digit_preservation(F.col("power").cast("string"), F.col("candidate").cast("string"))).withColumn("near", F.round(F.least(F.col("candidate") / F.col("median_power"), F.col("median_power") / F.col("candidate")), 6)).withColumn("score", F.round(0.55 * F.col("near") + 0.45 * F.col("kept"), 6)))
add("candidate_decision", lambda f: _decide(f))
add("content_reconcile", lambda f: gd.content_blocks(f.entries))
add("identity_fidelity", lambda f: f.entries.select("row_id", F.expr(gd.FIDELITY).alias("risk")), f"SELECT row_id, {_RISKY} AS risk FROM ent")
add("visible_rank_resolve", lambda f: f.entries.select("row_id", F.expr(gd.VISIBLE).alias("source")), f"SELECT row_id, {_SHOWS} AS source FROM ent")
add("power_guard_apply", lambda f: gd.power_sanity(f.entries).groupBy("server", "ranking_type", "decision").agg(F.count("*").alias("rows")),
    f"SELECT server, ranking_type, {_SANE} AS decision, count(*) AS rows FROM (SELECT *, quantile_cont(power, 0.5) OVER (PARTITION BY snapshot_id, source_file) AS median_power, lag(power) OVER (PARTITION BY snapshot_id, source_file ORDER BY rank, row_id) AS previous_power FROM ent) GROUP BY ALL")


def _decide(f: Frames):
    """The best repaired power per row if it leads the next by a margin, else ambiguous."""
    s = B.queries["candidate_scoring"](f.spark, f.sf_dir)
    w = W.partitionBy("row_id").orderBy(F.desc("score"), "candidate")
    top = s.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("n = 1")
    return top.select("row_id", "candidate", "score", F.expr("CASE WHEN score >= 0.62 AND score - coalesce(next, 0) >= 0.04 THEN 'recovered' ELSE 'ambiguous' END").alias("decision"))


# --- validation --------------------------------------------------------------
def truth(f: Frames):
    t = f.t("sheet_players").select(F.col("sheet_row_id").alias("truth_id"), "server", F.col("player").alias("name"), F.col("alliance").alias("tag"), F.col("thp").alias("power"))
    return place_within(t, "server", [F.desc_nulls_last("power"), F.col("truth_id")])


def seen(f: Frames):
    s = f.t("player_rankings").select(F.col("entry_id").alias("seen_id"), "server", F.col("player_name").alias("name"), F.col("alliance_tag").alias("tag"), "power")
    return place_within(s, "server", [F.desc_nulls_last("power"), F.col("seen_id")])


_TS = """, t AS (SELECT sheet_row_id AS truth_id, server, player AS name, alliance AS tag, thp AS power, row_number() OVER (PARTITION BY server ORDER BY thp DESC NULLS LAST, sheet_row_id) AS place FROM sheet_players),
s AS (SELECT entry_id AS seen_id, server, player_name AS name, alliance_tag AS tag, power, row_number() OVER (PARTITION BY server ORDER BY power DESC NULLS LAST, entry_id) AS place FROM player_rankings),
m0 AS (SELECT truth_id, seen_id, CASE WHEN lower(t.name) = lower(s.name) THEN 1 WHEN t.power = s.power THEN 2 ELSE 3 END AS tier, abs(t.power - s.power) AS off FROM t JOIN s ON t.server = s.server WHERE lower(t.name) = lower(s.name) OR t.power = s.power OR t.place = s.place),
m1 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY truth_id ORDER BY tier, off NULLS LAST, seen_id) = 1),
m AS (SELECT t.truth_id, seen_id, coalesce(tier, 0) AS tier FROM t LEFT JOIN m1 USING (truth_id))
"""
_CP = """CASE WHEN t.power IS NULL OR s.power IS NULL THEN 'missing' WHEN t.power = s.power THEN 'exact' WHEN abs(t.power - s.power)::DOUBLE / nullif(abs(t.power), 0) <= 1e-5 THEN 'near'
 WHEN length(s.power::VARCHAR) BETWEEN 7 AND 8 AND list_contains(list_transform(range(1, length(s.power::VARCHAR) + 1), lambda i: (s.power::VARCHAR)[1:i] || '0' || (s.power::VARCHAR)[i + 1:]), t.power::VARCHAR) THEN 'insert_zero'
 WHEN abs(t.power - s.power * 10)::DOUBLE / nullif(abs(t.power), 0) <= 0.005 THEN 'scale_x10_truncated_digit' ELSE 'mismatch' END"""
_DET = _TS + f""", q0 AS (SELECT m.*, t.server, {_CP} AS power_match, coalesce(lower(t.tag) = lower(s.tag), t.tag IS NULL AND s.tag IS NULL) AS tag_ok, coalesce(t.name = s.name, false) AS name_ok, coalesce(t.place = s.place, false) AS rank_ok FROM m JOIN t USING (truth_id) LEFT JOIN s ON s.seen_id = m.seen_id),
q1 AS (SELECT *, power_match IN ('exact', 'near', 'insert_zero', 'scale_x10_truncated_digit') AS power_ok FROM q0), q2 AS (SELECT *, CASE WHEN tier = 0 THEN 'missing' WHEN power_ok AND tag_ok AND name_ok THEN 'clean' WHEN power_ok AND tag_ok THEN 'name' WHEN power_ok THEN 'alliance' ELSE 'power' END AS triage FROM q1),
q AS (SELECT *, CASE triage WHEN 'clean' THEN 'none' WHEN 'name' THEN 'reread_name' WHEN 'alliance' THEN 'check_vocabulary' WHEN 'power' THEN 'reread_power' ELSE 'recapture' END AS plan FROM q2)
"""
add("truth_match_cascade", lambda f: va.match_cascade(truth(f), seen(f)), _TS + "SELECT * FROM m")
add("compare_power", lambda f: va.detail(truth(f), seen(f)).groupBy("power_match").agg(F.count("*").alias("n")), _DET + "SELECT power_match, count(*) AS n FROM q GROUP BY 1")
add("validate_detail", lambda f: va.detail(truth(f), seen(f)).select("truth_id", "seen_id", "tier", "power_match", "power_ok", "tag_ok", "name_ok", "rank_ok"), _DET + "SELECT truth_id, seen_id, tier, power_match, power_ok, tag_ok, name_ok, rank_ok FROM q")
_MET = """SELECT KEYS truth_rows, matched, good, precision, recall, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1,
 round(100 * (0.15::DOUBLE * matched / truth_rows + 0.15::DOUBLE * p + 0.10::DOUBLE * r + 0.20::DOUBLE * a + 0.40::DOUBLE * n), 2) AS score FROM (
 SELECT KEYS count(*) AS truth_rows, count(*) FILTER (WHERE tier > 0) AS matched, count(*) FILTER (WHERE tier > 0 AND power_ok) AS good, count(*) FILTER (WHERE power_ok)::DOUBLE / count(*) AS p, count(*) FILTER (WHERE rank_ok)::DOUBLE / count(*) AS r,
 count(*) FILTER (WHERE tag_ok)::DOUBLE / count(*) AS a, count(*) FILTER (WHERE name_ok)::DOUBLE / count(*) AS n, round(good::DOUBLE / greatest(matched, 1), 4) AS precision, round(good::DOUBLE / truth_rows, 4) AS recall FROM q GROUP)"""
add("validate_metrics", lambda f: va.metrics(va.detail(truth(f), seen(f)), ["server"]), _DET + _MET.replace("KEYS", "server,").replace("q GROUP", "q GROUP BY server"))
add("validation_summary", lambda f: va.metrics(va.detail(truth(f), seen(f)), []), _DET + _MET.replace("KEYS", "").replace("q GROUP", "q"))
add("triage", lambda f: va.detail(truth(f), seen(f)).select("truth_id", "triage", "plan"), _DET + "SELECT truth_id, triage, plan FROM q")
add("triage_rollup", lambda f: va.detail(truth(f), seen(f)).groupBy("server", "triage").agg(F.count("*").alias("rows")), _DET + "SELECT server, triage, count(*) AS rows FROM q GROUP BY ALL")
add("failure_rollups", lambda f: va.detail(truth(f), seen(f)).where("triage <> 'clean'").groupBy("plan").agg(F.count("*").alias("rows"), F.countDistinct("server").alias("servers")), _DET + "SELECT plan, count(*) AS rows, count(DISTINCT server) AS servers FROM q WHERE triage <> 'clean' GROUP BY 1")
add("stability_fingerprint", lambda f: va.detail(truth(f), seen(f)).select("truth_id", F.sha2(F.concat_ws("|", F.col("truth_id").cast("string"), F.col("tier").cast("string"), "power_match", "triage"), 256).alias("fingerprint")),
    _DET + "SELECT truth_id, sha256(concat_ws('|', truth_id::VARCHAR, tier::VARCHAR, power_match, triage)) AS fingerprint FROM q")
#: Options to resolve a case: name, gain, information, risk, effort.
OPTIONS = (("recapture", 0.9, 0.8, 0.2, 0.20), ("reread_power", 0.7, 0.6, 0.1, 0.05), ("reread_name", 0.6, 0.5, 0.1, 0.05), ("accept", 0.3, 0.1, 0.6, 0.0))
_UTIL = "round(0.45 * gain + 0.25 * info + 0.15 * CASE WHEN plan = option THEN 1 ELSE 0 END - 0.30 * risk - effort, 4)"
_OPT = ", ".join(f"('{o}', {g}::DOUBLE, {i}::DOUBLE, {r}::DOUBLE, {e}::DOUBLE)" for o, g, i, r, e in OPTIONS)


def simulator(f: Frames):
    cells = F.array(*[F.struct(F.lit(o).alias("option"), F.lit(g).alias("gain"), F.lit(i).alias("info"), F.lit(r).alias("risk"), F.lit(e).alias("effort")) for o, g, i, r, e in OPTIONS])
    d = va.detail(truth(f), seen(f)).where("triage <> 'clean'").select("truth_id", "plan", F.explode(cells).alias("o")).select("truth_id", "plan", "o.*")
    return d.withColumn("utility", F.expr(_UTIL).cast("double")).withColumn("place", F.row_number().over(W.partitionBy("truth_id").orderBy(F.desc("utility"), "option")))


add("resolution_simulator", lambda f: simulator(f).select("truth_id", "option", "utility", "place"), _DET + f"SELECT truth_id, option, ({_UTIL})::DOUBLE AS utility, row_number() OVER (PARTITION BY truth_id ORDER BY ({_UTIL})::DOUBLE DESC, option) AS place FROM q, (VALUES {_OPT}) o(option, gain, info, risk, effort) WHERE triage <> 'clean'")
add("option_rank", lambda f: simulator(f).where("place = 1").select("truth_id", "option"), _DET + f"SELECT truth_id, option FROM (SELECT truth_id, option, row_number() OVER (PARTITION BY truth_id ORDER BY ({_UTIL})::DOUBLE DESC, option) AS place FROM q, (VALUES {_OPT}) o(option, gain, info, risk, effort) WHERE triage <> 'clean') WHERE place = 1")
add("graph_assemble", lambda f: va.detail(truth(f), seen(f)).select("truth_id", F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in (("truth", "match"), ("match", "triage"), ("triage", "plan"))])).alias("e")).select("truth_id", "e.*"),
    _DET + "SELECT truth_id, e.* FROM q, (VALUES ('truth', 'match'), ('match', 'triage'), ('triage', 'plan')) e(source, target)")
add("review_binding", lambda f: seen(f).groupBy("server", F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("seen_id").alias("seen_id")).select("server", "key", F.expr("CASE WHEN n = 1 THEN 'BOUND' ELSE 'AMBIGUOUS' END").alias("state"), F.expr("CASE WHEN n = 1 THEN seen_id END").alias("seen_id")),
    _TS + "SELECT server, lower(name) AS key, CASE WHEN count(*) = 1 THEN 'BOUND' ELSE 'AMBIGUOUS' END AS state, CASE WHEN count(*) = 1 THEN min(seen_id) END AS seen_id FROM s GROUP BY server, lower(name)")
add("decision_history", lambda f: f.t("recruitment_targets").select("server", "name", "board_date", "priority").distinct().groupBy("server", "name").agg(F.min("board_date").alias("first_seen"), F.max("board_date").alias("last_seen"), F.countDistinct("board_date").alias("times_seen"), F.countDistinct("priority").alias("states")),
    "SELECT server, name, min(board_date) AS first_seen, max(board_date) AS last_seen, count(DISTINCT board_date) AS times_seen, count(DISTINCT priority) AS states FROM recruitment_targets GROUP BY ALL")
add("quality_memory", lambda f: f.entries.where("rank_warning is not null").groupBy("server", "rank_warning").agg(F.min("captured_at").alias("first_seen"), F.max("captured_at").alias("last_seen"), F.count("*").alias("times_seen")),
    "SELECT server, rank_warning, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) AS times_seen FROM ent WHERE rank_warning IS NOT NULL GROUP BY ALL")
add("review_history_merge", lambda f: f.entries.where("lane = 'server_review'").groupBy(F.substring(F.sha1(F.concat_ws("|", F.col("server").cast("string"), "name")), 1, 16).alias("case_id")).agg(F.count("*").alias("seen_count"), F.max("captured_at").alias("last_seen")))
add("snapshot_readiness", lambda f: f.star.groupBy("server", "ord").agg(F.countDistinct("ranking_type").alias("feeds"), F.countDistinct(F.when(F.col("rank") <= 10, F.concat("ranking_type", F.lit("|"), F.col("rank").cast("string")))).alias("top")).withColumn("completeness", F.round(F.col("top") * 5.0, 2)).withColumn("ready", F.expr("feeds = 2 AND top = 20")),
    "SELECT server, ord, count(DISTINCT ranking_type) AS feeds, count(DISTINCT CASE WHEN rank <= 10 THEN ranking_type || '|' || rank END) AS top, round(count(DISTINCT CASE WHEN rank <= 10 THEN ranking_type || '|' || rank END) * 5.0::DOUBLE, 2) AS completeness, count(DISTINCT ranking_type) = 2 AND count(DISTINCT CASE WHEN rank <= 10 THEN ranking_type || '|' || rank END) = 20 AS ready FROM star GROUP BY ALL")
add("snapshot_lifecycle", lambda f: f.snapshots.select("id", F.expr("CASE lower(status) WHEN 'complete' THEN 'CLOSED' WHEN 'pending' THEN 'COLLECTING' WHEN 'failed' THEN 'FAILED' WHEN 'deleted' THEN 'ARCHIVED' ELSE 'UNKNOWN' END").alias("stage")),
    "SELECT id, CASE lower(status) WHEN 'complete' THEN 'CLOSED' WHEN 'pending' THEN 'COLLECTING' WHEN 'failed' THEN 'FAILED' WHEN 'deleted' THEN 'ARCHIVED' ELSE 'UNKNOWN' END AS stage FROM snap")

# --- similarity joins and text functions -------------------------------------
add("seq_candidate_join", lambda f: _similar(f).where("agrees").withColumn("score", F.round(0.56 * F.col("p") + 0.29 * F.col("n") + 0.15 * F.col("a").cast("double"), 4)).where("score >= 0.78").groupBy("truth_id").agg(F.max(F.struct("score", (-F.col("seen_id")).alias("m"))).alias("b")).select("truth_id", (-F.col("b.m")).alias("seen_id"), F.col("b.score").alias("score")))
add("evidence_candidate_join", lambda f: va.evidence_candidates(truth(f), seen(f)).select("truth_id", "seen_id", "score"))
add("name_similarity", lambda f: _similar(f).select("truth_id", "seen_id", "n"))
add("player_identity", lambda f: _identity(f).where("score >= 70").select("truth_id", "seen_id", "score", F.expr("CASE WHEN score >= 85 THEN 'match' ELSE 'possible' END").alias("label")))
add("snapshot_match", lambda f: _greedy(f))
add("name_normalize", lambda f: f.t("entities").select("id", tx.identity_key("name").alias("key")))
add("name_category", lambda f: f.t("entities").groupBy(tx.name_category(F.col("name")).alias("category")).agg(F.count("*").alias("names")),
    "SELECT CASE WHEN l AND (h OR k OR c) THEN 'mixed_latin_cjk' WHEN l AND y THEN 'mixed_latin_cyrillic' WHEN h THEN 'hangul_only' WHEN k OR c THEN 'cjk_only' WHEN y THEN 'cyrillic_only' WHEN l THEN 'latin_only' ELSE 'symbols' END AS category, count(*) AS names FROM (SELECT coalesce(regexp_matches(name, '[A-Za-zÀ-ɏ]'), false) AS l, coalesce(regexp_matches(name, '[가-힣]'), false) AS h, coalesce(regexp_matches(name, '[぀-ヿ]'), false) AS k, coalesce(regexp_matches(name, '[一-鿿]'), false) AS c, coalesce(regexp_matches(name, '[Ѐ-ӿ]'), false) AS y FROM entities) GROUP BY 1")
add("char_alignment", lambda f: _similar(f).where("exact").select("truth_id", "seen_id", F.explode(tx.char_alignment(F.col("t_name"), F.col("s_name"))).alias("c")).groupBy("c.op").agg(F.count("*").alias("n")))
add("alliance_normalize", lambda f: _vocabulary(f))
add("token_predicates", lambda f: f.entries.where("name is not null").select("row_id", tx.is_noise(F.col("name")).alias("noise"), tx.is_rank(F.col("name")).alias("rank_like"), tx.is_power(F.col("name")).alias("power_like")),
    "SELECT row_id, trim(name) = '' OR lower(trim(name)) IN ('warzone', 'server', 'rank', 'alliance', 'power', 'ranking', 'commander') AS noise, regexp_full_match(name, '[0-9]{1,3}') AS rank_like, regexp_full_match(regexp_replace(name, '[., ]', '', 'g'), '[0-9]{6,12}') AS power_like FROM ent WHERE name IS NOT NULL")
add("identity_tokenize", lambda f: f.t("player_rankings").select("entry_id", F.posexplode(F.split("player_name", ""))).select("entry_id", "pos", tx.name_category(F.col("col")).alias("script")).withColumn("new", F.coalesce((F.lag("script").over(W.partitionBy("entry_id").orderBy("pos")) != F.col("script")).cast("int"), F.lit(1))).groupBy("entry_id").agg(F.sum("new").alias("tokens")))
add("magnitude_parse", lambda f: f.t("sheet_players").where("thp is not null").select("sheet_row_id", tx.parse_magnitude(F.concat(F.format_number("thp", 0), F.lit(""))).alias("full"), tx.parse_magnitude(F.concat((F.col("thp") / 1000000).cast("bigint").cast("string"), F.lit("m"))).alias("millions")),
    "SELECT sheet_row_id, thp AS full, (thp // 1000000) * 1000000 AS millions FROM sheet_players WHERE thp IS NOT NULL")
add("tag_name_split", lambda f: f.entries.where("name is not null and ranking_type = 'total_hero_power'").select("row_id", tx.split_tag(F.col("name")).alias("s")).select("row_id", "s.tag", "s.name"),
    r"SELECT row_id, nullif(regexp_extract(name, '^\[?([A-Za-z0-9]+)\]?\s*(.*)$', 1), '') AS tag, regexp_extract(name, '^\[?([A-Za-z0-9]+)\]?\s*(.*)$', 2) AS name FROM ent WHERE name IS NOT NULL AND ranking_type = 'total_hero_power'")


def _similar(f: Frames):
    """Candidate pairs of one server whose powers share a bucket of 6 percent or a neighbouring one, with name similarity."""
    bucket = lambda c: F.floor(F.log(F.col(c)) / 0.06)
    t = truth(f).where("power > 0").select("truth_id", "server", F.col("name").alias("t_name"), F.col("tag").alias("t_tag"), F.col("power").alias("t_power"), F.explode(F.array(bucket("power") - 1, bucket("power"), bucket("power") + 1)).alias("b"))
    s = seen(f).where("power > 0").select("seen_id", "server", F.col("name").alias("s_name"), F.col("tag").alias("s_tag"), F.col("power").alias("s_power"), bucket("power").alias("b"))
    j = t.join(s, ["server", "b"])
    rel = F.abs(F.col("t_power") - F.col("s_power")) / F.greatest("t_power", "s_power")
    return j.withColumns(
        {"p": 1 - rel, "exact": F.col("t_power") == F.col("s_power"), "agrees": rel <= 0.05, "a": F.coalesce(F.lower("t_tag") == F.lower("s_tag"), F.lit(False)), "n": tx.ratio(tx.identity_key("t_name"), tx.identity_key("s_name")), "rel": rel}
    )


def _identity(f: Frames):
    tag = F.when(F.col("t_tag").isNull() & F.col("s_tag").isNull(), 0.8).when(F.col("t_tag").isNull() | F.col("s_tag").isNull(), 0.4).when(F.col("a"), 1.0).otherwise(0.0)
    return _similar(f).withColumn("score", F.round(35 * F.col("n") + 40 * F.greatest(F.lit(0.0), 1 - F.col("rel") / 0.15) + 15 * tag + 10, 4))


def _greedy(f: Frames):
    pairs = _identity(f).where("score >= 70").select("server", "truth_id", "seen_id", "score")
    return va.greedy_pairs(pairs, "truth_id", "seen_id", "score")


def _vocabulary(f: Frames):
    vocabulary = f.t("sheet_players").select("server", F.col("alliance").alias("known"))
    tags = f.t("player_rankings").select("server", F.col("alliance_tag").alias("tag"))
    return va.normalize_tags(tags, vocabulary).select("server", "tag", "known", "state")


QUERIES, SQL = B.queries, B.sql
