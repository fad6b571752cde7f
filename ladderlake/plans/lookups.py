"""Cleaning functions, display buckets and further look-ups as named queries; the SQL twins are written out by themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions import cleaning as cl
from ladderlake.operators import analytics as an
from ladderlake.plans import analytics as pa
from ladderlake.plans import reasoning as pr
from ladderlake.plans.base import Book

B = Book()
add = B.add

# --- cleaning ----------------------------------------------------------------
add("is_warzone", lambda f: f.t("documents").select("doc_id", cl.is_warzone(F.col("text")).alias("warzone")).where("warzone").distinct(),
    r"SELECT DISTINCT doc_id, true AS warzone FROM documents WHERE regexp_matches(text, '(?i)[WQ][a-z0-9,\.\s]*z[oa][nmg][a-z0-9,\.\s]*[#\{\}]?\s*[0-9]{3,4}') OR regexp_matches(text, '(?i)warzone\s*[#\{\}]?\s*[0-9]{3,4}')")
add("server_candidates", lambda f: f.t("documents").select("doc_id", cl.server_candidates(F.col("text")).alias("s")).where("size(s) > 0").select("doc_id", F.col("s")[0].alias("server"), F.size("s").alias("candidates")).distinct())
add("clean_name_part", lambda f: f.entries.where("name is not null").select("row_id", cl.clean_name_part(F.col("name")).alias("part")),
    r"""SELECT row_id, CASE WHEN regexp_matches(upper(trim(name)), 'ALLIANCE POWER|TOTAL HERO POWER|RANKING|ALLIANCE NAME|COMMANDER|POWER|NOTE:|LEADERBOARD|UPDATES|IMPORTANT|PRESIDENT')
   OR regexp_matches(name, '(?i)[WQ][a-z0-9,\.\s]*z[oa][nmg][a-z0-9,\.\s]*[#\{\}]?\s*[0-9]{3,4}') OR regexp_full_match(trim(name), '[0-9]{1,3}')
   OR length(regexp_replace(translate(regexp_extract(trim(name), '[0-9OIl|][0-9OIl|,\.\s-]{6,}[0-9OIl|]'), 'OoIl|', '00111'), '[^0-9]', '', 'g')) >= 7 THEN '' ELSE trim(name) END AS part FROM ent WHERE name IS NOT NULL""")
add("clean_power", lambda f: f.entries.where("raw_text is not null").select("row_id", cl.clean_power(F.col("raw_text")).alias("power")),
    r"SELECT row_id, CASE WHEN length(d) >= 7 THEN TRY_CAST(d AS BIGINT) END AS power FROM (SELECT row_id, regexp_replace(translate(regexp_extract(raw_text, '[0-9OIl|][0-9OIl|,\.\s-]{6,}[0-9OIl|]'), 'OoIl|', '00111'), '[^0-9]', '', 'g') AS d FROM ent WHERE raw_text IS NOT NULL)")
add("tag_normalize", lambda f: f.t("player_rankings").select("entry_id", cl.normalize_tag(F.col("alliance_tag")).alias("r")).select("entry_id", "r.*"),
    r"SELECT entry_id, v AS value, CASE WHEN v = b THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence, v <> b AS corrected FROM (SELECT entry_id, b, regexp_replace(b, '[^A-Za-z0-9]', '', 'g') AS v FROM (SELECT entry_id, trim(regexp_replace(coalesce(alliance_tag, ''), '\s+', ' ', 'g')) AS b FROM player_rankings))")
add("player_name_normalize", lambda f: f.t("player_rankings").select("entry_id", cl.normalize_name(F.col("player_name")).alias("r")).select("entry_id", "r.*"))
add("power_normalize", lambda f: f.entries.where("raw_text is not null").select("row_id", cl.normalize_power(F.element_at(F.split("raw_text", " "), -1)).alias("r")).select("row_id", "r.value", "r.confidence"),
    "SELECT row_id, regexp_replace(m, '[^0-9]', '', 'g') AS value, round(1.0::DOUBLE - CASE WHEN m <> t THEN 0.04 ELSE 0 END - CASE WHEN regexp_replace(m, '[^0-9]', '', 'g') <> regexp_replace(t, '[^0-9]', '', 'g') THEN 0.02 ELSE 0 END, 4) AS confidence FROM (SELECT row_id, t, translate(t, 'OoIl|', '00111') AS m FROM (SELECT row_id, string_split(raw_text, ' ')[-1] AS t FROM ent WHERE raw_text IS NOT NULL))")
add("identity_parse", lambda f: f.entries.where("ranking_type = 'total_hero_power'").select("row_id", cl.parse_identity(F.col("name"), F.col("server_confidence")).alias("i")).select("row_id", "i.*"))
add("character_diff", lambda f: f.t("sheet_players").select("sheet_row_id", "server", F.col("thp").alias("power"), "player").where("power > 0").join(f.t("player_rankings").select("entry_id", "server", "power", "player_name"), ["server", "power"])
    .select("sheet_row_id", "entry_id", F.explode(cl.character_differences(F.col("player"), F.regexp_replace("player_name", r"^\s*\[[^\[\]]{1,8}\]\s*", ""))).alias("c")).select("sheet_row_id", "entry_id", "c.*"))
add("levenshtein_ops", lambda f: B.queries["character_diff"](f.spark, f.sf_dir).groupBy("op", "reason").agg(F.count("*").alias("steps")))

# --- display buckets ----------------------------------------------------------
# Limits of the icons of a score and of the names of a change in percent.
SCORE_ICONS = ((90, "trophy"), (80, "star"), (70, "green"), (60, "yellow"), (50, "orange"), (None, "red"))
CHANGES = ((20, "Explosive Growth"), (10, "Strong Growth"), (5, "Growing"), (-4.999999999, "Stable"), (-14.999999999, "Declining"), (None, "Heavy Decline"))
add("score_icon", lambda f: pa.scores(f).select("server", F.expr(an.graded("overall_score", SCORE_ICONS)).alias("icon")),
    pa._SCORES + "SELECT server, CASE WHEN overall_score < 50 THEN 'red' WHEN overall_score < 60 THEN 'orange' WHEN overall_score < 70 THEN 'yellow' WHEN overall_score < 80 THEN 'green' WHEN overall_score < 90 THEN 'star' ELSE 'trophy' END AS icon FROM scores")
add("classify_change", lambda f: pa.profile(f).select("server", "entity", F.expr(an.graded("power_pct", CHANGES)).alias("class")),
    pa._PROFILE + "SELECT server, entity, CASE WHEN power_pct <= -15 THEN 'Heavy Decline' WHEN power_pct <= -5 THEN 'Declining' WHEN power_pct < 5 THEN 'Stable' WHEN power_pct < 10 THEN 'Growing' WHEN power_pct < 20 THEN 'Strong Growth' ELSE 'Explosive Growth' END AS class FROM profile")


def shown(v: str) -> Column:
    """A value in billions or millions with two decimals, or whole with dots between thousands."""
    large, middle = F.format_string("%.2fB", F.round(F.col(v) / F.lit(1e9), 2)), F.format_string("%.2fM", F.round(F.col(v) / F.lit(1e6), 2))
    return F.when(F.abs(v) >= 1_000_000_000, large).when(F.abs(v) >= 1_000_000, middle).otherwise(F.translate(F.format_number(v, 0), ",", "."))


add("format_value", lambda f: pa.profile(f).withColumn("v", F.col("last_total") - F.col("first_total")).select("server", "entity", shown("v").alias("shown")),
    pa._PROFILE + "SELECT server, entity, CASE WHEN abs(v) >= 1000000000 THEN format('{:.2f}B', round(v / 1e9::DOUBLE, 2)) WHEN abs(v) >= 1000000 THEN format('{:.2f}M', round(v / 1e6::DOUBLE, 2)) ELSE replace(format('{:,}', v), ',', '.') END AS shown FROM (SELECT server, entity, last_total - first_total AS v FROM profile)")
add("president_view", lambda f: pa.profile(f).groupBy("server").agg(F.count_if(F.col("health") < 70).alias("weak"), F.count_if(F.col("health").between(70, 79)).alias("watch"), F.count_if(F.col("health") >= 80).alias("strong")).withColumn("summary", F.expr("CASE WHEN weak > strong THEN 'weak' WHEN strong > weak THEN 'strong' ELSE 'watch' END")),
    pa._PROFILE + "SELECT server, w AS weak, m AS watch, s AS strong, CASE WHEN w > s THEN 'weak' WHEN s > w THEN 'strong' ELSE 'watch' END AS summary FROM (SELECT server, sum((health < 70)::INT)::BIGINT AS w, sum((health >= 70 AND health < 80)::INT)::BIGINT AS m, sum((health >= 80)::INT)::BIGINT AS s FROM profile GROUP BY 1)")
add("average_confidence", lambda f: an.alliance_events(pa.profile(f)).groupBy("server").agg(F.round(F.sum("confidence") / F.count("*"), 4).alias("mean_confidence")),
    pa._PROFILE + "SELECT server, round(avg(confidence), 4) AS mean_confidence FROM events GROUP BY 1")
add("sort_descending", lambda f: pa.scores(f).orderBy(F.desc("overall_score"), "server").select("server", "overall_score"), pa._SCORES + "SELECT server, overall_score FROM scores ORDER BY overall_score DESC, server")

# --- look-ups -----------------------------------------------------------------
add("facts_by_entity", lambda f: pr.facts(f).join(pr.facts(f).groupBy("board").agg(F.min("entity_id").alias("entity_id")), ["board", "entity_id"], "left_semi").select(*pr.FC))
B.sql["facts_by_entity"] = (  # its common tables begin the statement
    pr._F + "SELECT fact_id, board, to_date, entity_id, severity FROM facts f WHERE entity_id = (SELECT min(entity_id) FROM facts g WHERE g.board = f.board)")
add("watch_by_type", lambda f: pr.watchlist(f).groupBy(F.when(F.col("weight") >= 3, "urgent").otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.max("score").alias("most")),
    pr._WATCH + "SELECT CASE weight WHEN 4 THEN 'urgent' WHEN 3 THEN 'urgent' ELSE 'other' END AS kind, count(*) AS n, max(score) AS most FROM w GROUP BY 1")
add("snapshot_history", lambda f: f.snapshots.join(F.broadcast(f.collections.select(F.col("id").alias("collection_id"), "ord")), "collection_id")  # 30 collections, fixed
    .select("server", "id", "ord", F.lower("status").alias("status"), F.lag(F.lower("status")).over(W.partitionBy("server").orderBy("ord", "id")).alias("before"), F.row_number().over(W.partitionBy("server").orderBy("ord", "id")).alias("place")),
    "SELECT server, snap.id, ord, lower(snap.status) AS status, lag(lower(snap.status)) OVER (PARTITION BY server ORDER BY ord, snap.id) AS before, row_number() OVER (PARTITION BY server ORDER BY ord, snap.id) AS place FROM snap JOIN coll ON snap.collection_id = coll.id")
add("quality_dashboard", lambda f: f.entries.groupBy("server").agg(
        F.count("*").alias("rows"), F.count_if(F.col("lane") == "server_review").alias("open_reviews"), F.count_if(F.col("lane").endswith("quarantine")).alias("quarantined"),
        F.count_if(F.col("rank_warning").isNotNull() | F.col("server_warning").isNotNull()).alias("warned"), F.countDistinct("snapshot_id").alias("imports"), F.max("captured_at").alias("latest")),
    "SELECT server, count(*) AS rows, count(*) FILTER (lane = 'server_review') AS open_reviews, count(*) FILTER (lane LIKE '%quarantine') AS quarantined, count(*) FILTER (NOT (rank_warning IS NULL AND server_warning IS NULL)) AS warned, count(DISTINCT snapshot_id) AS imports, max(captured_at) AS latest FROM ent GROUP BY 1")

QUERIES, SQL = B.queries, B.sql
