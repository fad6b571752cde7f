"""Warehouse queries: filters, joins, aggregations, windows, limits, set operations, sinks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.operators import warehouse as wh
from ladderlake.operators.ranks import place_within
from ladderlake.plans.base import Book

B = Book()
add = B.add
one = "*"
COLLECTION = "Season 11 Opening Census"

# --- filters and projections -------------------------------------------------
add("all_servers", lambda f: f.snapshots.select("server").where("server is not null").distinct().orderBy("server"),
    "SELECT DISTINCT server FROM snap WHERE server IS NOT NULL")
add("servers_in_collection", lambda f: f.star.where(F.col("collection") == COLLECTION).select("server").distinct(),
    f"SELECT DISTINCT server FROM star WHERE collection = '{COLLECTION}'")
add("collections_for_server", lambda f: f.star.where("server = 551").select("ord", "collection", "collection_type").distinct(),
    "SELECT DISTINCT ord, collection, collection_type FROM star WHERE server = 551")
add("has_collection", lambda f: f.collections.select("id", "name").join(f.snapshots.where("server = 551").select(F.col("collection_id").alias("id")), "id", "left_semi"),
    "SELECT id, name FROM coll WHERE EXISTS (SELECT 1 FROM snap WHERE snap.collection_id = coll.id AND server = 551)")
add("latest_snapshot", lambda f: wh.latest_per(f.snapshots.where("collection_id is not null"), ["collection_id", "server"], [F.desc("created_at"), F.desc("id")]).select("collection_id", "server", "id", "status"),
    "SELECT collection_id, server, id, status FROM snap WHERE collection_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection_id, server ORDER BY created_at DESC NULLS LAST, id DESC) = 1")
add("metric_lookup", lambda f: f.t("metrics").where("metric_name = 'total_power'").select("id", "snapshot_id", "value").distinct(),
    "SELECT DISTINCT id, snapshot_id, value FROM metrics WHERE metric_name = 'total_power'")
add("metrics_for_server", lambda f: f.t("metrics").select("id", "snapshot_id", "metric_name", "value").distinct().join(f.snapshots.where("server = 551").select(F.col("id").alias("snapshot_id")), "snapshot_id"),
    "SELECT m.snapshot_id, m.id, m.metric_name, m.value FROM (SELECT DISTINCT id, snapshot_id, metric_name, value FROM metrics) m JOIN snap ON m.snapshot_id = snap.id WHERE snap.server = 551")
add("cities_for_server", lambda f: f.t("city_stats").select("id", "snapshot_id", "alliance", "influence_points", (F.coalesce("city_level_1", F.lit(0)) + 2 * F.coalesce("city_level_2", F.lit(0)) + 3 * F.coalesce("city_level_3", F.lit(0))).alias("city_weight")).distinct()
    .join(f.snapshots.select(F.col("id").alias("snapshot_id"), "server"), "snapshot_id").orderBy("server", F.desc_nulls_last("influence_points"), "id"),
    "SELECT c.snapshot_id, c.id, c.alliance, c.influence_points, c.city_weight, snap.server FROM (SELECT DISTINCT id, snapshot_id, alliance, influence_points, coalesce(city_level_1, 0) + 2 * coalesce(city_level_2, 0) + 3 * coalesce(city_level_3, 0) AS city_weight FROM city_stats) c JOIN snap ON c.snapshot_id = snap.id")
add("influence_for_server", lambda f: f.t("city_stats").select("id", "snapshot_id", "alliance", "influence_points").distinct().join(f.snapshots.select(F.col("id").alias("snapshot_id"), "server"), "snapshot_id")
    .groupBy("server", "alliance").agg(F.sum("influence_points").alias("influence")),
    "SELECT server, alliance, sum(influence_points) AS influence FROM (SELECT DISTINCT id, snapshot_id, alliance, influence_points FROM city_stats) c JOIN snap ON c.snapshot_id = snap.id GROUP BY ALL")
add("complete_scoring_servers", lambda f: f.star.where("lane = 'operational'").groupBy("server").agg(
        F.countDistinct(F.when(F.col("ranking_type") == "alliance_power", F.col("ord"))).alias("points"), F.count_if(F.col("ranking_type") == "total_hero_power").alias("heroes")).where("points >= 2 and heroes > 0"),
    "SELECT server, count(DISTINCT ord) FILTER (WHERE ranking_type = 'alliance_power') AS points, count(*) FILTER (WHERE ranking_type = 'total_hero_power') AS heroes FROM star WHERE lane = 'operational' GROUP BY server HAVING points >= 2 AND heroes > 0")
add("historical_servers", lambda f: f.star.where("collection_type like 'trans%'").select("server").distinct(), "SELECT DISTINCT server FROM star WHERE collection_type LIKE 'trans%'")
add("operational_rows", lambda f: f.entries.where("lane = 'operational' and rank_warning is null and server_warning is null").select("row_id", "server", "ranking_type", "rank", "power"),
    "SELECT row_id, server, ranking_type, rank, power FROM ent WHERE lane = 'operational' AND rank_warning IS NULL AND server_warning IS NULL")
add("scope_to_truth", lambda f: f.entries.select("row_id", "server").join(f.t("sheet_players").select("server").distinct(), "server", "left_semi"),
    "SELECT row_id, server FROM ent WHERE server IN (SELECT server FROM sheet_players)")

# --- joins -------------------------------------------------------------------
add("ranking_star_join", lambda f: f.star.where("lane = 'operational' and ranking_type = 'alliance_power'").select("row_id", "server", "collection", "rank", "name", "power"),
    "SELECT row_id, server, collection, rank, name, power FROM star WHERE lane = 'operational' AND ranking_type = 'alliance_power'")
add("collection_summary_leftjoin", lambda f: f.snapshots.where("collection_id is not null").select(F.col("id").alias("snapshot_id"), "collection_id", "server").join(f.entries.select("snapshot_id", "ranking_type", "row_id"), "snapshot_id", "left")
    .groupBy("collection_id", "server", "ranking_type").agg(F.count("row_id").alias("rows")),
    "SELECT s.collection_id, s.server, e.ranking_type, count(e.row_id) AS rows FROM (SELECT id, collection_id, server FROM snap WHERE collection_id IS NOT NULL) s LEFT JOIN ent e ON e.snapshot_id = s.id GROUP BY ALL")
add("semi_in_subquery", lambda f: f.t("metrics").select("id", "snapshot_id").distinct().join(f.snapshots.where("lower(status) = 'deleted'").select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi"),
    "SELECT DISTINCT id, snapshot_id FROM metrics WHERE snapshot_id IN (SELECT id FROM snap WHERE lower(status) = 'deleted')")
add("frame_left_merge", lambda f: f.entries.select("row_id", "snapshot_id", "alliance_tag", "source_file").join(
        f.t("city_stats").groupBy("snapshot_id").agg(F.min("source_file").alias("city_source")), "snapshot_id", "left").select("row_id", F.coalesce(F.nullif(F.col("source_file"), F.lit("")), "city_source").alias("source"), F.col("city_source")),
    "SELECT row_id, coalesce(nullif(source_file, ''), city_source) AS source, city_source FROM ent LEFT JOIN (SELECT snapshot_id, min(source_file) AS city_source FROM city_stats GROUP BY 1) c USING (snapshot_id)")
add("expected_feed_anti", lambda f: f.star.select("server", "ord").distinct().withColumn("ranking_type", F.explode(F.array(F.lit("alliance_power"), F.lit("total_hero_power")))).join(f.star.select("server", "ord", "ranking_type"), ["server", "ord", "ranking_type"], "left_anti"),
    "SELECT s.server, s.ord, t.ranking_type FROM (SELECT DISTINCT server, ord FROM star) s, (VALUES ('alliance_power'), ('total_hero_power')) t(ranking_type) WHERE NOT EXISTS (SELECT 1 FROM star x WHERE x.server = s.server AND x.ord = s.ord AND x.ranking_type = t.ranking_type)")
#: Width of a logarithmic bucket of powers: powers within one percent of each other lie in one or in two neighbouring ones.
_BUCKET = "case when {x} > 0 then floor(ln({x}) / 0.0102) else {x} end"
add("trace_join", lambda f: wh.latest_per(
        f.t("player_rankings").where("parse_status = 'REVIEW'").select("entry_id", "server", F.col("power").alias("p")).withColumn("bucket", F.expr(_BUCKET.format(x="p")).cast("bigint"))
        .join(f.t("sheet_players").select("sheet_row_id", "server", "thp").withColumn("bucket", F.explode(F.expr(f"transform(array(-1, 0, 1), d -> cast({_BUCKET.format(x='thp')} as bigint) + d)"))), ["server", "bucket"])
        .withColumn("tier", F.expr("case when thp = p then 1 when abs(thp - p) <= 0.01 * p then 2 end")).where("tier is not null"),
        ["entry_id"], [F.col("tier"), F.expr("abs(thp - p)"), F.col("sheet_row_id")]).select("entry_id", "sheet_row_id", "tier"),
    "SELECT entry_id, sheet_row_id, CASE WHEN thp = power THEN 1 ELSE 2 END AS tier FROM player_rankings p JOIN sheet_players s USING (server) WHERE parse_status = 'REVIEW' AND (thp = power OR abs(thp - power) <= 0.01 * power) QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY tier, abs(thp - power), sheet_row_id) = 1")
add("source_evidence_join", lambda f: wh.latest_per(
        f.entries.where("lane <> 'operational'").select("row_id", "snapshot_id", "source_file", F.col("power").alias("p")).join(
            f.entries.where("lane = 'operational'").select(F.col("row_id").alias("trusted_id"), "snapshot_id", "source_file", F.col("power").alias("tp")), ["snapshot_id", "source_file"]),
        ["row_id"], [F.expr("abs(p - tp)").asc_nulls_last(), F.col("trusted_id")]).select("row_id", "trusted_id"),
    "SELECT q.row_id, t.row_id AS trusted_id FROM ent q JOIN ent t ON q.snapshot_id = t.snapshot_id AND q.source_file = t.source_file WHERE q.lane <> 'operational' AND t.lane = 'operational' QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY abs(q.power - t.power) NULLS LAST, t.row_id) = 1")

# --- aggregations ------------------------------------------------------------
add("collection_counts", lambda f: f.star.groupBy("ord", "collection").agg(F.count(one).alias("rows"), F.countDistinct("server").alias("servers"), F.countDistinct("snapshot_id").alias("snapshots"), F.countDistinct("source_file").alias("sources")),
    "SELECT ord, collection, count(*) AS rows, count(DISTINCT server) AS servers, count(DISTINCT snapshot_id) AS snapshots, count(DISTINCT source_file) AS sources FROM star GROUP BY ALL")
add("ranking_type_counts", lambda f: f.entries.groupBy("ranking_type").agg(F.count(one).alias("rows")), "SELECT ranking_type, count(*) AS rows FROM ent GROUP BY 1")
add("alliance_power_timeline", lambda f: f.ally.where("rank <= 10").groupBy("server", "ord", "collection").agg(F.sum("value").alias("total_power")),
    "SELECT server, ord, collection, CAST(sum(value) AS BIGINT) AS total_power FROM ally WHERE rank <= 10 GROUP BY ALL")
add("top10_power_sum", lambda f: f.ally.where("rank <= 10").groupBy("server", "ord").agg(F.sum("value").alias("p")).groupBy("server").agg(F.max_by("p", "ord").alias("latest_power")),
    "SELECT server, CAST(arg_max(p, ord) AS BIGINT) AS latest_power FROM (SELECT server, ord, sum(value) AS p FROM ally WHERE rank <= 10 GROUP BY ALL) GROUP BY 1")
add("historical_coverage", lambda f: f.star.groupBy("server", "ranking_type").agg(F.count(one).alias("rows")), "SELECT server, ranking_type, count(*) AS rows FROM star GROUP BY ALL HAVING count(*) > 0")
add("source_coverage", lambda f: f.star.groupBy("ord").agg(F.min("source_file").alias("first_source"), F.countDistinct("server").alias("servers"), F.count(one).alias("rows"), F.concat_ws(",", F.sort_array(F.collect_set("ranking_type"))).alias("types")),
    "SELECT ord, min(source_file) AS first_source, count(DISTINCT server) AS servers, count(*) AS rows, string_agg(DISTINCT ranking_type, ',' ORDER BY ranking_type) AS types FROM star GROUP BY 1")
add("import_run_rollup", lambda f: f.entries.groupBy("snapshot_id").agg(
        F.count(one).alias("rows"), F.count_if(F.col("lane") == "operational").alias("accepted"), F.count_if(F.col("lane").endswith("quarantine")).alias("quarantined"), F.count_if(F.col("lane") == "server_review").alias("review"),
        F.count_if(F.col("rank_warning").isNotNull()).alias("rank_warnings"), F.count_if(F.col("power").isNull()).alias("no_power"), F.countDistinct("source_file").alias("windows"),
        F.round(F.sum(F.round(F.col("server_confidence") * 100).cast("bigint")) / F.count("server_confidence"), 4).alias("mean_confidence")),
    "SELECT snapshot_id, count(*) AS rows, count(*) FILTER (WHERE lane = 'operational') AS accepted, count(*) FILTER (WHERE lane LIKE '%quarantine') AS quarantined, count(*) FILTER (WHERE lane = 'server_review') AS review, count(*) FILTER (WHERE rank_warning IS NOT NULL) AS rank_warnings, count(*) FILTER (WHERE power IS NULL) AS no_power, count(DISTINCT source_file) AS windows, round(sum(CAST(round(server_confidence * 100) AS BIGINT))::DOUBLE / count(server_confidence), 4) AS mean_confidence FROM ent GROUP BY 1")
_STATUS = "CASE WHEN conflicts > 0 THEN 'Review' WHEN warnings > 0 THEN 'Review' ELSE 'Ready' END"
_QUALITY = "CASE WHEN conflicts > 0 THEN 85 WHEN warnings > 0 THEN 90 ELSE 100 END"
add("group_status", lambda f: f.entries.groupBy("snapshot_id", "ranking_type").agg(F.count_if(F.col("server_warning").isNotNull()).alias("conflicts"), F.count_if(F.col("rank_warning").isNotNull()).alias("warnings")).withColumn("status", F.expr(_STATUS)).withColumn("quality", F.expr(_QUALITY)),
    f"SELECT *, {_STATUS} AS status, {_QUALITY} AS quality FROM (SELECT snapshot_id, ranking_type, count(*) FILTER (WHERE server_warning IS NOT NULL) AS conflicts, count(*) FILTER (WHERE rank_warning IS NOT NULL) AS warnings FROM ent GROUP BY ALL)")
add("rank_windows", lambda f: f.entries.groupBy("snapshot_id", "source_file").agg(F.min("ocr_rank").alias("min_rank"), F.max("ocr_rank").alias("max_rank"), F.countDistinct("ocr_rank").alias("ranks")),
    "SELECT snapshot_id, source_file, min(ocr_rank) AS min_rank, max(ocr_rank) AS max_rank, count(DISTINCT ocr_rank) AS ranks FROM ent GROUP BY ALL")
add("quality_by_server", lambda f: f.entries.groupBy("server").agg(F.count(one).alias("rows"), F.count_if(F.col("lane") == "operational").alias("valid")).withColumn("valid_ratio", F.round(F.col("valid") * 100.0 / F.col("rows"), 2)),
    "SELECT server, count(*) AS rows, count(*) FILTER (WHERE lane = 'operational') AS valid, round(valid * 100.0::DOUBLE / rows, 2) AS valid_ratio FROM ent GROUP BY 1")
_SHEET = "CASE WHEN ratio >= 95 THEN 'Ready' WHEN ratio >= 70 THEN 'Review' ELSE 'Incomplete' END"
add("quality_by_sheet", lambda f: f.t("sheet_players").groupBy("sheet").agg(F.count(one).alias("rows"), F.count_if(F.col("thp").isNotNull() & F.col("server").isNotNull() & F.col("alliance").isNotNull()).alias("valid")).withColumn("ratio", F.round(F.col("valid") * 100.0 / F.col("rows"), 2)).withColumn("status", F.expr(_SHEET)),
    f"SELECT *, {_SHEET} AS status FROM (SELECT sheet, count(*) AS rows, count(*) FILTER (WHERE thp IS NOT NULL AND server IS NOT NULL AND alliance IS NOT NULL) AS valid, round(valid * 100.0::DOUBLE / rows, 2) AS ratio FROM sheet_players GROUP BY 1)")
add("vote_majority", lambda f: wh.vote_majority(f.entries.where("alliance_tag is not null"), ["server", "name"], "alliance_tag", "captured_at").select("server", "name", "alliance_tag", "votes"),
    "SELECT server, name, alliance_tag, votes FROM (SELECT server, name, alliance_tag, count(*) AS votes, min(captured_at) AS f FROM ent WHERE alliance_tag IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY server, name ORDER BY votes DESC, f, alliance_tag) = 1")
add("provider_benchmark_score", lambda f: f.snapshots.join(f.entries.select(F.col("snapshot_id").alias("id"), "lane"), "id").groupBy("ocr_engine").agg(F.count(one).alias("rows"), F.count_if(F.col("lane") == "operational").alias("good"))
    .withColumn("score", F.round(0.6 * F.col("good") / F.col("rows") + 0.4 * F.col("rows") / F.max("rows").over(W.partitionBy()), 6)),  # one row per engine
    "SELECT *, round(0.6::DOUBLE * good / rows + 0.4::DOUBLE * rows / max(rows) OVER (), 6) AS score FROM (SELECT ocr_engine, count(*) AS rows, count(*) FILTER (WHERE lane = 'operational') AS good FROM snap JOIN ent ON ent.snapshot_id = snap.id GROUP BY 1)")
add("validation_category_rollup", lambda f: f.t("player_rankings").withColumn("category", F.expr("case when player_name rlike '[\\uac00-\\ud7a3]' then 'hangul' when player_name rlike '[\\u3040-\\u30ff]' then 'kana' when player_name rlike '[\\u0400-\\u04ff]' then 'cyrillic' when player_name rlike '[A-Za-z]' then 'latin' else 'other' end"))
    .groupBy("category").agg(F.count(one).alias("rows"), F.count_if(F.col("parse_status") == "VALID").alias("valid"), F.count_if(F.col("alliance_tag").isNull()).alias("no_tag"), F.sum("power").alias("power")),
    "SELECT CASE WHEN regexp_matches(player_name, '[가-힣]') THEN 'hangul' WHEN regexp_matches(player_name, '[぀-ヿ]') THEN 'kana' WHEN regexp_matches(player_name, '[Ѐ-ӿ]') THEN 'cyrillic' WHEN regexp_matches(player_name, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS category, count(*) AS rows, count(*) FILTER (WHERE parse_status = 'VALID') AS valid, count(*) FILTER (WHERE alliance_tag IS NULL) AS no_tag, CAST(sum(power) AS BIGINT) AS power FROM player_rankings GROUP BY 1")

# --- windows -----------------------------------------------------------------
add("computed_rank", lambda f: place_within(f.t("sheet_players").where("thp is not null").select("sheet_row_id", "server", "thp"), "server", [F.desc("thp"), F.col("sheet_row_id")], "computed").select("sheet_row_id", "server", "computed"),
    "SELECT sheet_row_id, server, row_number() OVER (PARTITION BY server ORDER BY thp DESC, sheet_row_id) AS computed FROM sheet_players WHERE thp IS NOT NULL")
add("limit_per_collection", lambda f: wh.top_n(f.hero, ["ord"], [F.desc("value"), F.col("server"), F.col("entity")], 20).select("ord", "place", "server", "entity", "value"),
    "SELECT ord, row_number() OVER (PARTITION BY ord ORDER BY value DESC, server, entity) AS place, server, entity, value FROM hero QUALIFY place <= 20")
add("top10_per_snapshot", lambda f: f.star.where("rank <= 10 and lane = 'operational'").select("row_id", "snapshot_id", "ranking_type", "rank"), "SELECT row_id, snapshot_id, ranking_type, rank FROM star WHERE rank <= 10 AND lane = 'operational'")
add("alliance_histories", lambda f: f.ally.groupBy("server", "entity").agg(F.array_sort(F.collect_list(F.struct("ord", "rank", "value"))).alias("h"))
    .select("server", "entity", F.size("h").alias("points"), F.concat_ws(";", F.transform("h", lambda x: F.concat_ws(":", x["ord"].cast("string"), x["rank"].cast("string")))).alias("path")),
    "SELECT server, entity, count(*) AS points, string_agg(ord || ':' || rank, ';' ORDER BY ord) AS path FROM ally GROUP BY ALL")
add("step_changes", lambda f: wh.step_changes(f.ally, ["server", "entity"], "ord", "value").select("server", "entity", "ord", "change", "percent"),
    "SELECT server, entity, ord, value - lag(value) OVER w AS change, round((value - lag(value) OVER w) * 100.0::DOUBLE / lag(value) OVER w, 4) AS percent FROM ally WINDOW w AS (PARTITION BY server, entity ORDER BY ord)")
add("first_last", lambda f: f.ally.groupBy("server", "entity").agg(F.min_by("value", "ord").alias("first_value"), F.max_by("value", "ord").alias("last_value"), F.min_by("rank", "ord").alias("first_rank"), F.max_by("rank", "ord").alias("last_rank")),
    "SELECT server, entity, arg_min(value, ord) AS first_value, arg_max(value, ord) AS last_value, arg_min(rank, ord) AS first_rank, arg_max(rank, ord) AS last_rank FROM ally GROUP BY ALL")
add("share_of_total", lambda f: f.ally.where("rank <= 10").withColumn("share", F.round(F.col("value") / F.sum("value").over(W.partitionBy("server", "ord")), 6)).select("server", "ord", "rank", "share"),
    "SELECT server, ord, rank, round(value::DOUBLE / sum(value) OVER (PARTITION BY server, ord)::DOUBLE, 6) AS share FROM ally WHERE rank <= 10")
add("gap_islands", lambda f: wh.gap_islands(f.entries.select("snapshot_id", "ranking_type", "rank"), 20),
    """, f AS (SELECT DISTINCT snapshot_id, ranking_type, rank FROM ent WHERE rank BETWEEN 1 AND 20),
    g AS (SELECT *, lag(rank) OVER w AS p, lead(rank) OVER w AS n FROM f WINDOW w AS (PARTITION BY snapshot_id, ranking_type ORDER BY rank)),
    i AS (SELECT snapshot_id, ranking_type, coalesce(p, 0) + 1 AS gap_start, rank - 1 AS gap_end, p AS previous_anchor, rank AS next_anchor FROM g WHERE rank - coalesce(p, 0) > 1
      UNION ALL SELECT snapshot_id, ranking_type, rank + 1, 20, rank, NULL FROM g WHERE n IS NULL AND rank < 20)
    SELECT *, gap_end - gap_start + 1 AS gap_rows, previous_anchor IS NOT NULL AND next_anchor IS NOT NULL AS bounded FROM i""")
add("row_slot", lambda f: f.entries.withColumn("slot", F.row_number().over(W.partitionBy("snapshot_id", "source_file").orderBy("rank", "row_id")) - 1).select("row_id", "slot"),
    "SELECT row_id, row_number() OVER (PARTITION BY snapshot_id, source_file ORDER BY rank, row_id) - 1 AS slot FROM ent")
add("pending_rank_gap", lambda f: f.entries.where("ocr_rank is not null").withColumn("before", F.lag("ocr_rank").over(W.partitionBy("snapshot_id", "source_file").orderBy("ocr_rank", "row_id"))).where("ocr_rank - before > 1")
    .select("row_id", F.concat_ws(",", F.transform(F.sequence(F.col("before") + 1, F.col("ocr_rank") - 1), lambda x: x.cast("string"))).alias("missing")),
    "SELECT row_id, array_to_string(range(before + 1, ocr_rank), ',') AS missing FROM (SELECT row_id, ocr_rank, lag(ocr_rank) OVER (PARTITION BY snapshot_id, source_file ORDER BY ocr_rank, row_id) AS before FROM ent WHERE ocr_rank IS NOT NULL) WHERE ocr_rank - before > 1")
add("power_order_vs_slot", lambda f: f.entries.where("power is not null").withColumn("by_power", F.row_number().over(W.partitionBy("snapshot_id", "source_file").orderBy(F.desc("power"), "row_id")))
    .withColumn("by_rank", F.row_number().over(W.partitionBy("snapshot_id", "source_file").orderBy("rank", "row_id"))).where("by_power <> by_rank").select("row_id", "by_power", "by_rank"),
    "SELECT row_id, row_number() OVER (PARTITION BY snapshot_id, source_file ORDER BY power DESC, row_id) AS by_power, row_number() OVER (PARTITION BY snapshot_id, source_file ORDER BY rank, row_id) AS by_rank FROM ent WHERE power IS NOT NULL QUALIFY by_power <> by_rank")
add("source_median", lambda f: f.entries.where("power < 1000000000000000").groupBy("snapshot_id", "source_file").agg(F.median("power").cast("bigint").alias("median_power")),
    "SELECT snapshot_id, source_file, CAST(trunc(median(power)) AS BIGINT) AS median_power FROM ent WHERE power < 1000000000000000 GROUP BY ALL")
add("source_index", lambda f: f.entries.select("snapshot_id", "ranking_type", "source_file").distinct().withColumn("source_index", F.dense_rank().over(W.partitionBy("snapshot_id", "ranking_type").orderBy("source_file"))),
    "SELECT DISTINCT snapshot_id, ranking_type, source_file, dense_rank() OVER (PARTITION BY snapshot_id, ranking_type ORDER BY source_file) AS source_index FROM ent")
_ANCHOR = "0.30 + 0.16 * (CASE WHEN gap_rows = 1 THEN 1.0 ELSE 0.5 END) + 0.30 * (CASE WHEN bounded THEN 1.0 ELSE 0.0 END) + 0.14 * (CASE WHEN gap_rows <= 3 THEN 1.0 ELSE 0.0 END) + 0.10"
add("context_inference", lambda f: wh.gap_islands(f.entries.where("lane = 'operational'").select("snapshot_id", "ranking_type", "rank"))
    .withColumn("confidence", F.round(F.expr(_ANCHOR), 4)).where("confidence >= 0.88").select("snapshot_id", "ranking_type", "gap_start", "gap_end", "confidence"),
    f""", f AS (SELECT DISTINCT snapshot_id, ranking_type, rank FROM ent WHERE lane = 'operational' AND rank >= 1),
    g AS (SELECT *, lag(rank) OVER (PARTITION BY snapshot_id, ranking_type ORDER BY rank) AS p FROM f),
    i AS (SELECT snapshot_id, ranking_type, coalesce(p, 0) + 1 AS gap_start, rank - 1 AS gap_end, p IS NOT NULL AS bounded, rank - 1 - coalesce(p, 0) AS gap_rows FROM g WHERE rank - coalesce(p, 0) > 1)
    SELECT snapshot_id, ranking_type, gap_start, gap_end, round(({_ANCHOR})::DOUBLE, 4) AS confidence FROM i WHERE round(({_ANCHOR})::DOUBLE, 4) >= 0.88""")

# --- set operations ----------------------------------------------------------
_READY = "CASE WHEN failed THEN 'failed' WHEN pending THEN 'pending' WHEN NOT (ally AND hero) THEN 'missing' ELSE 'operational' END"
add("readiness_sets", lambda f: f.snapshots.select("server", F.col("id").alias("snapshot_id"), F.lower("status").alias("st")).join(f.entries.select("snapshot_id", "ranking_type").distinct(), "snapshot_id", "left").groupBy("server").agg(
        F.max_by(F.col("st") == "failed", F.col("snapshot_id")).alias("failed"), F.max_by(F.col("st") == "pending", F.col("snapshot_id")).alias("pending"),
        F.coalesce(F.bool_or(F.col("ranking_type") == "alliance_power"), F.lit(False)).alias("ally"), F.coalesce(F.bool_or(F.col("ranking_type") == "total_hero_power"), F.lit(False)).alias("hero")).withColumn("state", F.expr(_READY)).select("server", "state"),
    f"SELECT server, {_READY} AS state FROM (SELECT server, arg_max(lower(status) = 'failed', id) AS failed, arg_max(lower(status) = 'pending', id) AS pending, coalesce(bool_or(ranking_type = 'alliance_power'), false) AS ally, coalesce(bool_or(ranking_type = 'total_hero_power'), false) AS hero FROM snap LEFT JOIN (SELECT DISTINCT snapshot_id, ranking_type FROM ent) e ON e.snapshot_id = snap.id GROUP BY server)")
_REQ = "SELECT snapshot_id, ranking_type, count(DISTINCT rank) AS found_ranks, array_to_string(list_filter(range(1, 11), lambda x: NOT list_contains(list(DISTINCT rank), x)), ',') AS missing_ranks, round(count(DISTINCT rank) * 100.0::DOUBLE / 10, 2) AS completeness FROM ent WHERE rank BETWEEN 1 AND 10 GROUP BY ALL"
add("required_ranks_check", lambda f: wh.required_ranks(f.entries, ["snapshot_id", "ranking_type"], 10), _REQ)
add("server_quality_gate", lambda f: wh.required_ranks(f.star, ["server", "ord", "ranking_type"], 10).groupBy("server", "ord").agg(F.count(one).alias("rankings"), F.min("completeness").alias("worst"))
    .withColumn("gate", F.expr("case when rankings = 2 and worst >= 100 then 'PASSED' else 'FAILED' end")),
    "SELECT server, ord, count(*) AS rankings, min(c) AS worst, CASE WHEN count(*) = 2 AND min(c) >= 100 THEN 'PASSED' ELSE 'FAILED' END AS gate FROM (SELECT server, ord, ranking_type, round(count(DISTINCT rank) * 100.0::DOUBLE / 10, 2) AS c FROM star WHERE rank BETWEEN 1 AND 10 GROUP BY ALL) GROUP BY ALL")
add("tag_overlap", lambda f: f.ally.where("rank <= 10").alias("a").join(f.ally.where("rank <= 10").alias("b"), (F.col("a.server") == F.col("b.server")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("b.ord") == F.col("a.ord") + 1)).groupBy(F.col("a.server").alias("server"), F.col("a.ord").alias("ord")).agg(F.count(one).alias("common")),
    "SELECT a.server, a.ord, count(*) AS common FROM ally a JOIN ally b ON a.server = b.server AND a.entity = b.entity AND b.ord = a.ord + 1 WHERE a.rank <= 10 AND b.rank <= 10 GROUP BY ALL")
add("tags_superset", lambda f: f.entries.where("alliance_tag is not null").groupBy("snapshot_id").agg(F.bool_or(F.col("lane") == "operational").alias("a"), F.bool_or(F.col("ranking_type") == "alliance_power").alias("b")).where("a and b").select("snapshot_id"),
    "SELECT snapshot_id FROM ent WHERE alliance_tag IS NOT NULL GROUP BY 1 HAVING bool_or(lane = 'operational') AND bool_or(ranking_type = 'alliance_power')")
add("server_union", lambda f: f.t("sheet_players").select("server").union(f.t("player_rankings").select("server")).union(f.t("pact_entries").select("server")).where("server is not null").distinct(),
    "SELECT server FROM sheet_players WHERE server IS NOT NULL UNION SELECT server FROM player_rankings WHERE server IS NOT NULL UNION SELECT server FROM pact_entries WHERE server IS NOT NULL")
add("history_union", lambda f: f.ally.where("ord <= 10").select("server", "entity").distinct().withColumn("known", F.lit(True)).unionByName(
        f.ally.where("ord > 10").select("server", "entity").distinct().join(f.ally.where("ord <= 10").select("server", "entity"), ["server", "entity"], "left_anti").withColumn("known", F.lit(False))),
    "SELECT DISTINCT server, entity, true AS known FROM ally WHERE ord <= 10 UNION ALL SELECT DISTINCT server, entity, false FROM ally a WHERE ord > 10 AND NOT EXISTS (SELECT 1 FROM ally b WHERE b.ord <= 10 AND b.server = a.server AND b.entity = a.entity)")

# --- sinks -------------------------------------------------------------------
add("sink_upsert_ranking", lambda f: wh.latest_per(f.entries, ["snapshot_id", "ranking_type", "rank"], [F.desc("captured_at"), F.desc("row_id")]).select("snapshot_id", "ranking_type", "rank", "row_id", "power"),
    "SELECT snapshot_id, ranking_type, rank, row_id, power FROM ent QUALIFY row_number() OVER (PARTITION BY snapshot_id, ranking_type, rank ORDER BY captured_at DESC, row_id DESC) = 1")
add("sink_get_or_create", lambda f: wh.get_or_create(f.t("entities").where("entity_type = 'player'"), f.t("player_rankings").select(F.col("alliance_tag").alias("tag"), F.col("player_name").alias("name")), ["tag", "name"]).groupBy("is_new").agg(F.countDistinct("key").alias("keys")),
    "SELECT is_new, count(*) AS keys FROM (SELECT DISTINCT coalesce(tag, '') AS tag, name, false AS is_new FROM entities WHERE entity_type = 'player' UNION ALL SELECT DISTINCT coalesce(alliance_tag, ''), player_name, true FROM player_rankings p WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.entity_type = 'player' AND coalesce(e.tag, '') = coalesce(p.alliance_tag, '') AND e.name = p.player_name)) GROUP BY 1")
add("sink_screenshot_dedup", lambda f: f.t("ranking_rows").select(F.sha2(F.concat_ws("|", "source_file", F.date_format("captured_at", "yyyy-MM-dd")), 256).alias("sha256")).dropDuplicates(["sha256"]),
    "SELECT DISTINCT sha256(source_file || '|' || strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m-%d')) AS sha256 FROM ranking_rows")
add("sink_delete_cascade", lambda f: wh.delete_cascade(f.snapshots, f.snapshots.where("lower(status) = 'failed'"), f.entries, "id", "snapshot_id")[1].groupBy("server").agg(F.count(one).alias("rows")),
    "SELECT server, count(*) AS rows FROM ent WHERE snapshot_id NOT IN (SELECT id FROM snap WHERE lower(status) = 'failed') GROUP BY 1")
add("sink_update_status", lambda f: f.snapshots.select("id", F.when(F.lower("status") == "pending", "complete").otherwise(F.lower("status")).alias("status")), "SELECT id, CASE WHEN lower(status) = 'pending' THEN 'complete' ELSE lower(status) END AS status FROM snap")
add("fix_ranks", lambda f: f.entries.where("power is not null").withColumn("fixed", F.row_number().over(W.partitionBy("snapshot_id", "ranking_type").orderBy(F.desc("power"), "row_id"))).select("row_id", "fixed"),
    "SELECT row_id, row_number() OVER (PARTITION BY snapshot_id, ranking_type ORDER BY power DESC, row_id) AS fixed FROM ent WHERE power IS NOT NULL")
add("sink_snapshot_revision", lambda f: f.t("candidate_snapshots").groupBy("board", "taken_on", "delivery_id").agg(F.max("received_at").alias("at")).withColumn("revision", F.row_number().over(W.partitionBy("board", "taken_on").orderBy("at", "delivery_id"))).select("board", "taken_on", "delivery_id", "revision"),
    "SELECT board, taken_on, delivery_id, row_number() OVER (PARTITION BY board, taken_on ORDER BY got, delivery_id) AS revision FROM (SELECT board, taken_on, delivery_id, max(received_at) AS got FROM candidate_snapshots GROUP BY ALL)")
add("snapshot_latest", lambda f: wh.latest_per(f.t("candidate_snapshots").groupBy("board", "taken_on", "delivery_id").agg(F.max("received_at").alias("at"), F.count(one).alias("rows")), ["board"], [F.desc("taken_on"), F.desc("at"), F.desc("delivery_id")]).select("board", "taken_on", "delivery_id", "rows"),
    "SELECT board, taken_on, delivery_id, rows FROM (SELECT board, taken_on, delivery_id, max(received_at) AS got, count(*) AS rows FROM candidate_snapshots GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY board ORDER BY taken_on DESC, got DESC, delivery_id DESC) = 1")

QUERIES, SQL = B.queries, B.sql
