"""Server and alliance analytics as named queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.operators import analytics as an
from ladderlake.plans.base import Book, Frames

B = Book()


def scores(f: Frames):
    return an.server_scores(f.ally, f.hero)


def profile(f: Frames):
    return an.alliance_profile(f.ally)


_SCORES = f"""
, best AS (SELECT * FROM ally WHERE rank <= 10),
totals AS (SELECT server, ord, sum(value) AS total FROM best GROUP BY ALL),
line0 AS (SELECT server, count(*) AS points, CAST(arg_min(total, ord) AS BIGINT) AS first_total, CAST(arg_max(total, ord) AS BIGINT) AS last_total, max(ord) AS last_ord, stddev_pop(total) AS sd, sum(total)::DOUBLE / count(*) AS mean FROM totals GROUP BY 1),
line AS (SELECT *, {an.PCT} AS growth_pct, CASE WHEN mean > 0 THEN sd / mean * 100 ELSE 100.0 END AS volatility FROM line0),
lastb AS (SELECT best.*, row_number() OVER (PARTITION BY best.server ORDER BY value, entity) AS i FROM best JOIN line ON best.server = line.server AND best.ord = line.last_ord),
depth AS (SELECT server, count(*) AS alliances, 2.0::DOUBLE * sum(i * value) / (count(*) * sum(value)::DOUBLE) - (count(*) + 1.0::DOUBLE) / count(*) AS gini, sum(value) AS v, sum(value) FILTER (WHERE rank = 1) AS top1, sum(value) FILTER (WHERE rank <= 3) AS top3 FROM lastb GROUP BY 1),
newest AS (SELECT server, max(ord) AS ord FROM hero GROUP BY 1),
players AS (SELECT server, count(*) AS players, sum(value)::DOUBLE / count(*) AS mean_thp, median(value) AS median_thp, count(*) FILTER (WHERE value >= 300e6) AS elite_300, count(*) FILTER (WHERE value >= 320e6) AS elite_320, count(*) FILTER (WHERE value >= 350e6) AS elite_350 FROM hero JOIN newest USING (server, ord) WHERE rank <= 10 GROUP BY 1),
joined AS (SELECT line.*, coalesce(alliances, 0) AS alliances, gini, v, top1, top3, coalesce(players, 0) AS players, mean_thp, median_thp, elite_300, elite_320, elite_350 FROM line LEFT JOIN depth USING (server) LEFT JOIN players USING (server)),
s0 AS (SELECT *, coalesce(({an.GROWTH})::DOUBLE, 0) AS growth_score, coalesce(({an.POWER})::DOUBLE, 0) AS power_score, coalesce(({an.DEPTH})::DOUBLE, 0) AS depth_score, coalesce(({an.PLAYER})::DOUBLE, 0) AS player_score, coalesce(({an.STABILITY})::DOUBLE, 0) AS stability_score FROM joined),
scores AS (SELECT *, ({an.OVERALL})::DOUBLE AS overall_score FROM s0)
"""
_PROFILE = f"""
, pbest AS (SELECT * FROM ally WHERE rank <= 10),
span AS (SELECT server, min(ord) AS first_seen, max(ord) AS latest FROM pbest GROUP BY 1),
steps AS (SELECT *, CASE WHEN lag(value) OVER w > 0 THEN (value - lag(value) OVER w) * 100.0::DOUBLE / lag(value) OVER w END AS step_pct FROM pbest WINDOW w AS (PARTITION BY server, entity ORDER BY ord)),
one AS (SELECT server, entity, count(*) AS points, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(value, ord) AS first_total, arg_max(value, ord) AS last_total, arg_min(rank, ord) AS first_rank, arg_max(rank, ord) AS last_rank,
  round(coalesce(max(step_pct), 0), 4) AS max_gain, round(coalesce(min(step_pct), 0), 4) AS max_drop, round(coalesce(avg(abs(step_pct)), 0), 4) AS volatility FROM steps GROUP BY ALL),
p0 AS (SELECT one.*, first_seen, latest, round({an.PCT}, 4) AS power_pct, first_rank - last_rank AS rank_gain, last_ord <> latest AS left_top10, first_ord = latest AND latest > first_seen AS entered FROM one JOIN span USING (server)),
pm AS (SELECT *, points >= 2 AND first_total > 0 AND abs(power_pct) >= 5 AS pmoved, points >= 2 AND rank_gain <> 0 AS rmoved FROM p0),
p1 AS (SELECT *, CASE WHEN points < 3 THEN 'COLLAPSING' WHEN max_drop <= -10 AND power_pct > 0 THEN 'RECOVERING' WHEN power_pct >= 15 AND volatility < 15 THEN 'GROWING'
    WHEN power_pct <= -10 THEN 'DECLINING' WHEN abs(power_pct) < 5 THEN 'STABLE' WHEN volatility > 20 THEN 'VOLATILE' ELSE 'UNKNOWN' END AS trend,
  least(100, greatest(0, 70 - 45 * left_top10::INT + 18 * entered::INT - 20 * (last_ord < latest)::INT
    + (CASE WHEN NOT pmoved THEN 0 WHEN power_pct >= 25 THEN 20 WHEN power_pct >= 10 THEN 10 WHEN power_pct <= -25 THEN -30 WHEN power_pct <= -10 THEN -18 ELSE 0 END)
    + (CASE WHEN NOT rmoved THEN 0 WHEN rank_gain >= 3 THEN 8 WHEN rank_gain <= -3 THEN -12 ELSE 0 END))) AS health FROM pm),
profile AS (SELECT *, CASE trend WHEN 'COLLAPSING' THEN 95 WHEN 'RECOVERING' THEN 92 WHEN 'GROWING' THEN 90 WHEN 'DECLINING' THEN 88 WHEN 'STABLE' THEN 85 WHEN 'VOLATILE' THEN 83 ELSE 70 END AS trend_confidence,
  CASE WHEN health < 30 THEN 'Critical' WHEN health < 50 THEN 'Declining' WHEN health < 70 THEN 'Unstable' WHEN health < 85 THEN 'Healthy' ELSE 'Excellent' END AS health_status,
  CASE WHEN health < 50 THEN 'HIGH' WHEN health < 75 THEN 'MEDIUM' ELSE 'LOW' END AS health_risk,
  CASE WHEN pmoved THEN (CASE WHEN power_pct >= 15 THEN 'Growing' WHEN power_pct <= -15 THEN 'Declining' ELSE 'Mixed' END) ELSE 'Stable' END AS health_trend FROM p1),
events AS (
  SELECT server, entity, 'LEFT_TOP10' AS event_type, 'HIGH' AS severity, 90 AS confidence FROM profile WHERE left_top10
  UNION ALL SELECT server, entity, 'ENTERED_TOP10', CASE WHEN last_rank <= 5 THEN 'HIGH' ELSE 'MEDIUM' END, 90 FROM profile WHERE entered
  UNION ALL SELECT server, entity, 'RANK_CHANGED', CASE WHEN abs(rank_gain) < 3 THEN 'LOW' WHEN abs(rank_gain) < 5 THEN 'MEDIUM' ELSE 'HIGH' END, 85 FROM profile WHERE rmoved
  UNION ALL SELECT server, entity, 'POWER_CHANGED', CASE WHEN abs(power_pct) < 8 THEN 'LOW' WHEN abs(power_pct) < 15 THEN 'MEDIUM' WHEN abs(power_pct) < 30 THEN 'HIGH' ELSE 'CRITICAL' END, 85 FROM profile WHERE pmoved)
"""
_TARGETS = _PROFILE + _SCORES + """, rated AS (SELECT p.*, s.overall_score, s.player_score, s.growth_pct, s.volatility AS server_volatility,
   least(100, CASE health_status WHEN 'Critical' THEN 40 + 20 WHEN 'Declining' THEN 25 + 10 WHEN 'Unstable' THEN 10 ELSE 0 END + CASE health_trend WHEN 'Declining' THEN 15 WHEN 'Mixed' THEN 5 ELSE 0 END
     + CASE health_risk WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 5 ELSE 0 END + CASE WHEN overall_score >= 55 THEN 10 ELSE 0 END + CASE WHEN player_score >= 65 THEN 10 ELSE 0 END) AS priority,
   least(100, 40 + CASE health_status WHEN 'Critical' THEN 20 + 15 WHEN 'Declining' THEN 15 + 10 WHEN 'Unstable' THEN 8 ELSE 0 END + CASE health_trend WHEN 'Declining' THEN 10 ELSE 0 END
     + CASE health_risk WHEN 'HIGH' THEN 10 ELSE 0 END + CASE WHEN overall_score >= 55 THEN 5 ELSE 0 END + CASE WHEN player_score >= 65 THEN 5 ELSE 0 END) AS target_confidence
   FROM profile p JOIN scores s USING (server)),
acted AS (SELECT *, CASE WHEN priority < 30 THEN 'Ignore' WHEN priority < 50 THEN 'Watch' WHEN priority < 70 THEN 'Monitor closely' WHEN priority < 85 THEN 'High priority' ELSE 'Contact immediately' END AS action FROM rated),
targets AS (SELECT * FROM acted WHERE priority > 0)
"""


def score_query(name: str, columns: list[str]) -> None:
    B.add(name, lambda f: scores(f).select("server", *columns), _SCORES + f"SELECT server, {', '.join(columns)} FROM scores")


score_query("score_growth", ["points", "growth_score"])
score_query("score_power", ["last_total", "power_score"])
score_query("score_depth", ["alliances", "top1", "top3", "depth_score"])
score_query("score_player", ["players", "elite_300", "elite_320", "elite_350", "median_thp", "player_score"])
score_query("score_stability", ["points", "stability_score"])
B.add("gini", lambda f: scores(f).select("server", F.round("gini", 6).alias("gini")), _SCORES + "SELECT server, round(gini, 6) AS gini FROM scores")
B.add("score_overall", lambda f: scores(f).select("server", *an.WEIGHTS, "overall_score"), _SCORES + f"SELECT server, {', '.join(an.WEIGHTS)}, overall_score FROM scores")
B.add("server_dna", lambda f: scores(f).select("server", *[F.expr(an.graded(f"{n}_score", t)).alias(f"{n}_trait") for n, t in an.TRAITS.items()], F.expr(an.graded("overall_score", an.RISK_LIMITS)).alias("risk"), F.expr(an.graded("overall_score", an.ADVICE)).alias("advice")),
      _SCORES + """SELECT server,
   CASE WHEN growth_score < 45 THEN 'Weak Growth' WHEN growth_score < 65 THEN 'Moderate Growth' WHEN growth_score < 85 THEN 'Growing' ELSE 'Explosive Growth' END AS growth_trait,
   CASE WHEN power_score < 45 THEN 'Low Power' WHEN power_score < 65 THEN 'Medium Power' WHEN power_score < 85 THEN 'Strong' ELSE 'Powerhouse' END AS power_trait,
   CASE WHEN depth_score < 45 THEN 'Top Heavy' WHEN depth_score < 60 THEN 'Moderate Alliance Structure' WHEN depth_score < 80 THEN 'Balanced Alliance Structure' ELSE 'Deep Alliance Structure' END AS depth_trait,
   CASE WHEN player_score < 45 THEN 'Weak Player Base' WHEN player_score < 65 THEN 'Average Player Base' WHEN player_score < 85 THEN 'Strong Player Base' ELSE 'Elite Player Base' END AS player_trait,
   CASE WHEN stability_score < 45 THEN 'Highly Volatile' WHEN stability_score < 65 THEN 'Some Volatility' WHEN stability_score < 85 THEN 'Stable' ELSE 'Extremely Stable' END AS stability_trait,
   CASE WHEN overall_score < 55 THEN 'HIGH' WHEN overall_score < 75 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
   CASE WHEN overall_score < 40 THEN 'Avoid unless there are special reasons' WHEN overall_score < 55 THEN 'Risky Target' WHEN overall_score < 70 THEN 'Situational Target' WHEN overall_score < 85 THEN 'Strong Transfer Target' ELSE 'Excellent Transfer Target' END AS advice
 FROM scores""")
B.add("recruitment_class", lambda f: scores(f).select("server", F.expr(an.STARS).alias("stars")), _SCORES + f"SELECT server, {an.STARS} AS stars FROM scores")
B.add("trend_icon", lambda f: scores(f).select("server", F.expr(an.graded("growth_pct", an.ICONS)).alias("icon"), F.format_string("%.2fB", F.col("last_total") / F.lit(1e9)).alias("shown")),
      _SCORES + "SELECT server, CASE WHEN growth_pct <= -15 THEN 'skull' WHEN growth_pct <= -5 THEN 'falling' WHEN growth_pct < 5 THEN 'flat' WHEN growth_pct < 15 THEN 'up' WHEN growth_pct < 30 THEN 'rising' ELSE 'rocket' END AS icon, format('{:.2f}B', last_total / 1e9) AS shown FROM scores")
B.add("overall_rank_top30", lambda f: scores(f).where("overall_score > 0").orderBy(F.desc("overall_score"), "server").limit(30).select("server", "overall_score"),
      _SCORES + "SELECT server, overall_score FROM scores WHERE overall_score > 0 ORDER BY overall_score DESC, server LIMIT 30")
B.add("growth_rank_topbottom", lambda f: scores(f).select("server", "growth_score").orderBy(F.desc("growth_score"), "server").limit(20).withColumn("side", F.lit("top")).unionByName(
        scores(f).select("server", "growth_score").orderBy("growth_score", "server").limit(10).withColumn("side", F.lit("bottom"))),
      _SCORES + "(SELECT server, growth_score, 'top' AS side FROM scores ORDER BY growth_score DESC, server LIMIT 20) UNION ALL (SELECT server, growth_score, 'bottom' AS side FROM scores ORDER BY growth_score, server LIMIT 10)")
P = ["server", "entity"]


def profile_query(name: str, columns: list[str]) -> None:
    B.add(name, lambda f: profile(f).select(*P, *columns), _PROFILE + f"SELECT server, entity, {', '.join(columns)} FROM profile")


profile_query("timeline_metrics", ["points", "max_gain", "max_drop", "volatility", "power_pct", "rank_gain"])
profile_query("timeline_trend", ["trend", "trend_confidence"])
profile_query("alliance_health", ["health", "health_status", "health_risk", "health_trend"])


def event_query(name: str, kind: str) -> None:
    B.add(name, lambda f: an.alliance_events(profile(f)).where(F.col("event_type") == kind), _PROFILE + f"SELECT * FROM events WHERE event_type = '{kind}'")


for _name, _kind in (("event_left_top10", "LEFT_TOP10"), ("event_entered_top10", "ENTERED_TOP10"), ("event_rank_changed", "RANK_CHANGED"), ("event_power_changed", "POWER_CHANGED")):
    event_query(_name, _kind)
B.add("event_sort", lambda f: an.alliance_events(profile(f)).withColumn("weight", F.expr(an.SEVERITY_ORDER)).orderBy(F.desc("weight"), "server", "entity", "event_type"), _PROFILE + f"SELECT *, {an.SEVERITY_ORDER} AS weight FROM events")


def targets(f: Frames):
    return an.recruitment_targets(profile(f), scores(f))


B.add("recruitment_target", lambda f: targets(f).where("server = 551").select(*P, "priority", "action", "target_confidence"), _TARGETS + "SELECT server, entity, priority, action, target_confidence FROM targets WHERE server = 551")
B.add("recruitment_all", lambda f: targets(f).select(*P, "priority", "action", "target_confidence"), _TARGETS + "SELECT server, entity, priority, action, target_confidence FROM targets")
_ASSESS = "least(12 * n, 60) + least(10 * high, 30) + CASE WHEN n > 0 THEN 10 ELSE 0 END"
B.add("health_assessment", lambda f: an.alliance_events(profile(f)).groupBy(*P).agg(F.count("*").alias("n"), F.count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high")).withColumn("confidence", F.expr(_ASSESS)),
      _PROFILE + f"SELECT server, entity, n, high, {_ASSESS} AS confidence FROM (SELECT server, entity, count(*) AS n, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high FROM events GROUP BY ALL)")


def signals(f: Frames):
    return an.signal_context(an.with_priority(profile(f), scores(f)))


CONTEXT = [
    "event_count", "high_impact_events", "medium_impact_events", "low_impact_events", "left_top10_count", "entered_top10_count", "power_change_count", "large_power_loss_count", "large_power_gain_count", "rank_change_count",
    "alliance_count", "critical_alliances", "declining_alliances", "unstable_alliances", "healthy_alliances", "excellent_alliances", "high_risk_alliances", "medium_risk_alliances", "low_risk_alliances",
    "recruitment_target_count", "immediate_targets", "high_priority_targets", "watch_targets", "overall", "player",
]
_SIGNALS = _TARGETS + """, ev AS (SELECT server, count(*) AS event_count, count(*) FILTER (severity = 'CRITICAL') AS critical_events, count(*) FILTER (severity IN ('HIGH', 'CRITICAL')) AS high_impact_events,
   count(*) FILTER (severity = 'MEDIUM') AS medium_impact_events, count(*) FILTER (severity = 'LOW') AS low_impact_events, count(*) FILTER (event_type = 'LEFT_TOP10') AS left_top10_count, count(*) FILTER (event_type = 'ENTERED_TOP10') AS entered_top10_count,
   count(*) FILTER (event_type = 'POWER_CHANGED') AS power_change_count, count(*) FILTER (event_type = 'RANK_CHANGED') AS rank_change_count FROM events GROUP BY 1),
al AS (SELECT server, count(*) AS alliance_count, count(*) FILTER (pmoved AND power_pct <= -10) AS large_power_loss_count, count(*) FILTER (pmoved AND power_pct >= 15) AS large_power_gain_count,
   count(*) FILTER (health_status = 'Critical') AS critical_alliances, count(*) FILTER (health_status = 'Declining') AS declining_alliances, count(*) FILTER (health_status = 'Unstable') AS unstable_alliances,
   count(*) FILTER (health_status = 'Healthy') AS healthy_alliances, count(*) FILTER (health_status = 'Excellent') AS excellent_alliances, count(*) FILTER (health_risk = 'HIGH') AS high_risk_alliances,
   count(*) FILTER (health_risk = 'MEDIUM') AS medium_risk_alliances, count(*) FILTER (health_risk = 'LOW') AS low_risk_alliances, count(*) FILTER (priority > 0) AS recruitment_target_count,
   count(*) FILTER (action = 'Contact immediately') AS immediate_targets, count(*) FILTER (action = 'High priority') AS high_priority_targets, count(*) FILTER (action = 'Watch') AS watch_targets,
   count(*) FILTER (trend = 'COLLAPSING') AS collapsing, count(*) FILTER (trend = 'GROWING') AS growing, count(*) FILTER (trend = 'DECLINING') AS declining, count(*) FILTER (trend = 'RECOVERING') AS recovering,
   count(*) FILTER (health < 50) AS weak, count(*) FILTER (health >= 80) AS strong, max(overall_score) AS overall, max(player_score) AS player, max(growth_pct) AS growth, max(server_volatility) AS volatility FROM acted GROUP BY 1),
sig AS (SELECT al.*, coalesce(event_count, 0) AS event_count, coalesce(critical_events, 0) AS critical_events, coalesce(high_impact_events, 0) AS high_impact_events, coalesce(medium_impact_events, 0) AS medium_impact_events, coalesce(low_impact_events, 0) AS low_impact_events,
   coalesce(left_top10_count, 0) AS left_top10_count, coalesce(entered_top10_count, 0) AS entered_top10_count, coalesce(power_change_count, 0) AS power_change_count, coalesce(rank_change_count, 0) AS rank_change_count FROM al LEFT JOIN ev USING (server))
"""
B.add("signal_context", lambda f: signals(f).select("server", *CONTEXT), _SIGNALS + f"SELECT server, {', '.join(CONTEXT)} FROM sig")
B.add("recruitment_rules", lambda f: an.recruitment_rules(signals(f)), _SIGNALS + """, hit AS (SELECT server, left_top10_count > 0 AS a, large_power_loss_count > 0 AS b, volatility >= 8 AS c, overall >= 55 AS d, player >= 65 AS e, overall < 40 AND player < 65 AS f, growth >= 10 AND volatility < 8 AS g,
   left_top10_count AS na, large_power_loss_count AS nb FROM sig)
 SELECT server, least(100, greatest(0, 25 * a::INT + 25 * b::INT + 20 * c::INT + 15 * d::INT + 15 * e::INT - 25 * f::INT - 20 * g::INT)) AS score,
   least(60, 15 * (a::INT + b::INT + c::INT + d::INT + e::INT + f::INT + g::INT)) + least(40, 8 * (na + nb + c::INT + d::INT + e::INT + 2 * f::INT + 2 * g::INT)) AS confidence,
   a::INT + b::INT + c::INT + d::INT + e::INT + f::INT + g::INT AS matched FROM hit""")


def insights(f: Frames):
    return an.insights(signals(f))


_LEVEL = "CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
_INSIGHTS = _SIGNALS + """, ins AS (
   SELECT server, 'Strong Server' AS title, 'GROWTH' AS category, 'MEDIUM' AS priority, 94 AS confidence, 58 AS impact FROM sig WHERE overall >= 70 AND growth >= 10
   UNION ALL SELECT server, 'Internal Restructuring', 'RISK', 'HIGH', 96, 82 FROM sig WHERE left_top10_count >= 2 AND critical_alliances >= 2
   UNION ALL SELECT server, 'Recruitment Opportunity', 'RECRUITMENT', 'HIGH', 92, 82 FROM sig WHERE immediate_targets >= 2
   UNION ALL SELECT server, 'Alliance Growth', 'COMPETITION', 'MEDIUM', 90, 58 FROM sig WHERE large_power_gain_count >= 2
   UNION ALL SELECT server, 'High Volatility', 'RISK', 'MEDIUM', 88, 58 FROM sig WHERE volatility >= 10
   UNION ALL SELECT server, 'Weak Server', 'RISK', 'HIGH', 87, 82 FROM sig WHERE overall < 40
   UNION ALL SELECT server, 'Healthy Environment', 'STABILITY', 'LOW', 91, 25 FROM sig WHERE critical_alliances = 0 AND growth >= 10 AND volatility < 8)
"""
B.add("insight_rules", insights, _INSIGHTS + "SELECT * FROM ins")
B.add("topic_build", lambda f: insights(f).groupBy("server", "category").agg(
        F.max(F.struct(F.expr(_LEVEL).alias("level"), "confidence", "title")).alias("m"), F.count("*").alias("n"), F.sum("confidence").alias("c")).select("server", "category", F.col("m.title").alias("primary_title"), "n", F.round(F.col("c") / F.col("n"), 4).alias("mean_confidence")),
      _INSIGHTS + "SELECT server, category, arg_max(title, ((impact, confidence, title))) AS primary_title, count(*) AS n, round(sum(confidence)::DOUBLE / count(*), 4) AS mean_confidence FROM ins GROUP BY ALL")
B.add("topic_sort", lambda f: insights(f).withColumn("place", F.row_number().over(W.partitionBy("server").orderBy(F.desc(F.expr(_LEVEL)), F.desc("confidence"), "title"))),
      _INSIGHTS + "SELECT *, row_number() OVER (PARTITION BY server ORDER BY impact DESC, confidence DESC, title) AS place FROM ins")
B.add("feed_filter", lambda f: insights(f).where("impact >= 70"), _INSIGHTS + "SELECT * FROM ins WHERE priority IN ('HIGH', 'CRITICAL')")
B.add("intelligence_feed", lambda f: insights(f).groupBy("server").agg(F.max("impact").alias("impact"), F.count("*").alias("items")), _INSIGHTS + "SELECT server, max(impact) AS impact, count(*) AS items FROM ins GROUP BY 1")
_VIEW = "CASE WHEN mean < 70 THEN 'weak' WHEN mean < 80 THEN 'watch' ELSE 'strong' END"
B.add("brief_sections", lambda f: profile(f).groupBy("server").agg((F.sum("health").cast("double") / F.count("*")).alias("mean")).select("server", F.expr(_VIEW).alias("section"), F.round("mean", 2).alias("mean_health")),
      _PROFILE + f"SELECT server, {_VIEW} AS section, round(mean, 2) AS mean_health FROM (SELECT server, sum(health)::DOUBLE / count(*) AS mean FROM profile GROUP BY 1)")
_DASH = "least(100, 15 * critical_events + 7 * (high_impact_events - critical_events) + 3 * medium_impact_events)"
B.add("dashboard", lambda f: signals(f).select("server", F.expr(_DASH).alias("risk"), F.expr(f"100 - {_DASH}").alias("health"), F.expr("least(100, 35 + 15 * growing)").alias("progress"), F.expr("least(100, 70 + 8 * strong)").alias("success")),
      _SIGNALS + f"SELECT server, {_DASH} AS risk, 100 - {_DASH} AS health, least(100, 35 + 15 * growing) AS progress, least(100, 70 + 8 * strong) AS success FROM sig")
B.add("server_overview", lambda f: signals(f).select("server", F.expr("least(100, 12 * collapsing)").alias("risk"), F.expr("least(100, 14 * weak)").alias("opportunity")),
      _SIGNALS + "SELECT server, least(100, 12 * collapsing) AS risk, least(100, 14 * weak) AS opportunity FROM sig")
_OUT = "CASE WHEN collapsing >= 3 THEN 90 WHEN declining >= 2 THEN 88 WHEN growing >= 2 THEN 85 WHEN recovering >= 1 THEN 75 ELSE 70 END"
_OUTLOOK = "CASE WHEN collapsing >= 3 THEN 'Collapse' WHEN declining >= 2 THEN 'Decline' WHEN growing >= 2 THEN 'Growth' WHEN recovering >= 1 THEN 'Recovery' ELSE 'Steady' END"
B.add("server_intelligence", lambda f: signals(f).select("server", F.expr(_OUTLOOK).alias("outlook"), F.expr(_OUT).alias("confidence")), _SIGNALS + f"SELECT server, {_OUTLOOK} AS outlook, {_OUT} AS confidence FROM sig")
_HYP = "CASE WHEN trend = 'COLLAPSING' AND health_status = 'Critical' THEN 96 WHEN trend = 'RECOVERING' AND health_status IN ('Healthy', 'Excellent') THEN 90 END"
B.add("hypothesis_engine", lambda f: profile(f).withColumn("confidence", F.expr(_HYP)).where("confidence is not null").select(*P, "confidence", F.when(F.col("confidence") == 96, "CRITICAL").otherwise("MEDIUM").alias("severity")),
      _PROFILE + f"SELECT server, entity, {_HYP} AS confidence, CASE WHEN {_HYP} = 96 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity FROM profile WHERE {_HYP} IS NOT NULL")
B.add("outlook_engine", lambda f: profile(f).withColumn("c", F.expr(_HYP)).where("c is not null").groupBy("server").agg(F.count_if(F.col("c") == 96).alias("risks"), F.count_if(F.col("c") == 90).alias("opportunities"), F.max("c").alias("confidence")),
      _PROFILE + f"SELECT server, count(*) FILTER (WHERE c = 96) AS risks, count(*) FILTER (WHERE c = 90) AS opportunities, max(c) AS confidence FROM (SELECT server, {_HYP} AS c FROM profile) WHERE c IS NOT NULL GROUP BY 1")
B.add("situation", lambda f: an.alliance_events(profile(f)).withColumn("weight", F.expr(an.SEVERITY_ORDER)).groupBy(*P).agg(F.max(F.struct("weight", "event_type")).alias("m"), F.round(F.sum("confidence") / F.count("*"), 4).alias("mean_confidence")).select(*P, F.col("m.event_type").alias("leading"), "mean_confidence"),
      _PROFILE + f"SELECT server, entity, arg_max(event_type, ({an.SEVERITY_ORDER}, event_type)) AS leading, round(sum(confidence)::DOUBLE / count(*), 4) AS mean_confidence FROM events GROUP BY ALL")
B.add("ranking_recruitment", lambda f: targets(f).withColumn("place", F.row_number().over(W.partitionBy("server").orderBy(F.desc("priority"), F.desc("target_confidence"), "entity"))).select(*P, "priority", "place"),
      _TARGETS + "SELECT server, entity, priority, row_number() OVER (PARTITION BY server ORDER BY priority DESC, target_confidence DESC, entity) AS place FROM targets")
B.add("ranking_growth", lambda f: profile(f).withColumn("place", F.row_number().over(W.partitionBy("server").orderBy(F.desc("power_pct"), "entity"))).select(*P, "power_pct", "place"),
      _PROFILE + "SELECT server, entity, power_pct, row_number() OVER (PARTITION BY server ORDER BY power_pct DESC, entity) AS place FROM profile")
B.add("ranking_sorts", lambda f: targets(f).orderBy(F.desc("priority"), F.desc("trend_confidence"), "server", "entity").limit(50).select(*P, "priority"),
      _TARGETS + "SELECT server, entity, priority FROM targets ORDER BY priority DESC, trend_confidence DESC, server, entity LIMIT 50")
B.add("campaign_plan", lambda f: targets(f).withColumn("phase", F.expr("CASE WHEN priority >= 90 THEN 1 WHEN priority >= 70 THEN 2 END")).where("phase is not null").groupBy("server", "phase").agg(F.count("*").alias("targets"), F.count_if(F.col("health_risk") == "HIGH").alias("risks")),
      _TARGETS + "SELECT server, CASE WHEN priority >= 90 THEN 1 ELSE 2 END AS phase, count(*) AS targets, count(*) FILTER (WHERE health_risk = 'HIGH') AS risks FROM targets WHERE priority >= 70 GROUP BY ALL")
_STATE = "CASE WHEN quality >= 100 THEN 'READY' WHEN quality >= 70 THEN 'PARTIAL' ELSE 'INCOMPLETE' END"
B.add("server_landscape", lambda f: f.star.where("rank <= 10").groupBy("server", "ord", "ranking_type").agg(F.countDistinct("rank").alias("n")).groupBy("server").agg(F.round(F.sum("n") * 10.0 / F.count("*"), 2).alias("quality")).withColumn("state", F.expr(_STATE)),
      f"SELECT *, {_STATE} AS state FROM (SELECT server, round(sum(n) * 10.0::DOUBLE / count(*), 2) AS quality FROM (SELECT server, ord, ranking_type, count(DISTINCT rank) AS n FROM star WHERE rank <= 10 GROUP BY ALL) GROUP BY 1)")
B.add("entity_report", lambda f: an.with_priority(profile(f), scores(f)).select(*P, "points", "trend", "health", F.expr("int(left_top10) + int(entered) + int(rank_moved) + int(power_moved)").alias("events"), "priority"),
      _TARGETS + "SELECT p.server, p.entity, p.points, p.trend, p.health, coalesce(e.n, 0) AS events, p.priority FROM acted p LEFT JOIN (SELECT server, entity, count(*) AS n FROM events GROUP BY ALL) e ON p.server = e.server AND p.entity = e.entity")
B.add("weighted_score", lambda f: targets(f).select(*P, F.round(F.col("priority") * F.col("trend_confidence") / 100.0, 4).alias("weighted")), _TARGETS + "SELECT server, entity, round(priority * trend_confidence / 100.0::DOUBLE, 4) AS weighted FROM targets")
B.add("server_signal_sort", lambda f: insights(f).orderBy("server", F.desc("impact"), F.desc("confidence"), "title").select("server", "title", "priority"), _INSIGHTS + "SELECT server, title, priority FROM ins")

QUERIES, SQL = B.queries, B.sql
