"""Scores, events, trends, health and recruitment of servers and their alliances.

One plan computes all servers at once.  Rules are expressions in SQL text, so
that the same rule table serves the DataFrame operators and the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear(x: str, low: float, high: float) -> str:
    """0 at ``low`` and below, 100 at ``high`` and above, linear between, two decimals."""
    return f"CASE WHEN {x} <= {low} THEN 0.0 WHEN {x} >= {high} THEN 100.0 ELSE round(({x} - {low}) / ({high} - {low}) * 100, 2) END"


def falling(x: str, high: float) -> str:
    """100 at 0 and below, 0 at ``high`` and above."""
    return f"CASE WHEN {x} <= 0 THEN 100.0 WHEN {x} >= {high} THEN 0.0 ELSE round((1 - {x} / {high}) * 100, 2) END"


# The limits, points, weights and names of the scores, events and trends below.
PCT = "CASE WHEN first_total > 0 THEN (last_total - first_total) * 100.0e0 / first_total ELSE 0.0e0 END"
GROWTH = f"CASE WHEN points < 2 THEN 0.0 ELSE {linear('growth_pct', -10.0, 30.0)} END"
POWER = linear("last_total", 50e9, 250e9)
DEPTH = f"CASE WHEN alliances < 3 THEN 0.0 ELSE {falling('gini', 0.60)} END"
PLAYER = f"CASE WHEN players < 5 THEN 0.0 ELSE {linear('mean_thp', 180e6, 350e6)} END"
STABILITY = f"CASE WHEN points < 3 THEN 0.0 ELSE {falling('volatility', 25.0)} END"
WEIGHTS = {"growth_score": 0.30, "power_score": 0.35, "depth_score": 0.20, "player_score": 0.15, "stability_score": 0.10}
#: The billionth settles ties of the second decimal alike wherever the expression runs.
OVERALL = "round((" + " + ".join(f"{w} * {c}" for c, w in WEIGHTS.items()) + f") / {sum(WEIGHTS.values()):.2f} + 1e-9, 2)"
# Limits and names of the traits of a server, of its risk and of the advice that goes with its overall score.
TRAITS = {
    "growth": ((85, "Explosive Growth"), (65, "Growing"), (45, "Moderate Growth"), (None, "Weak Growth")),
    "power": ((85, "Powerhouse"), (65, "Strong"), (45, "Medium Power"), (None, "Low Power")),
    "depth": ((80, "Deep Alliance Structure"), (60, "Balanced Alliance Structure"), (45, "Moderate Alliance Structure"), (None, "Top Heavy")),
    "player": ((85, "Elite Player Base"), (65, "Strong Player Base"), (45, "Average Player Base"), (None, "Weak Player Base")),
    "stability": ((85, "Extremely Stable"), (65, "Stable"), (45, "Some Volatility"), (None, "Highly Volatile")),
}
RISK_LIMITS = ((75, "LOW"), (55, "MEDIUM"), (None, "HIGH"))
ADVICE = ((85, "Excellent Transfer Target"), (70, "Strong Transfer Target"), (55, "Situational Target"), (40, "Risky Target"), (None, "Avoid unless there are special reasons"))


def graded(x: str, limits: tuple) -> str:
    """The name of the first limit that ``x`` reaches; the last one has none."""
    return "CASE " + " ".join(f"WHEN {x} >= {low} THEN '{name}'" for low, name in limits[:-1]) + f" ELSE '{limits[-1][1]}' END"


STARS = "CASE WHEN overall_score >= 80 THEN 5 WHEN overall_score >= 60 THEN 4 WHEN overall_score >= 40 THEN 3 WHEN overall_score >= 20 THEN 2 ELSE 1 END"
# Limits of the growth in percent that the icons of a trend stand for; the first one below all.
ICONS = ((30, "rocket"), (15, "rising"), (5, "up"), (-4.999999999, "flat"), (-14.999999999, "falling"), (None, "skull"))

RANK_SEVERITY = "CASE WHEN abs(rank_gain) >= 5 THEN 'HIGH' WHEN abs(rank_gain) >= 3 THEN 'MEDIUM' ELSE 'LOW' END"
POWER_SEVERITY = "CASE WHEN abs(power_pct) >= 30 THEN 'CRITICAL' WHEN abs(power_pct) >= 15 THEN 'HIGH' WHEN abs(power_pct) >= 8 THEN 'MEDIUM' ELSE 'LOW' END"
SEVERITY_ORDER = "CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 ELSE 25 END"
TREND = (
    "CASE WHEN points < 3 THEN 'COLLAPSING' WHEN max_drop <= -10 AND power_pct > 0 THEN 'RECOVERING' WHEN power_pct >= 15 AND volatility < 15 THEN 'GROWING' "
    "WHEN power_pct <= -10 THEN 'DECLINING' WHEN abs(power_pct) < 5 THEN 'STABLE' WHEN volatility > 20 THEN 'VOLATILE' ELSE 'UNKNOWN' END"
)
TREND_CONFIDENCE = "CASE trend WHEN 'COLLAPSING' THEN 95 WHEN 'RECOVERING' THEN 92 WHEN 'GROWING' THEN 90 WHEN 'DECLINING' THEN 88 WHEN 'STABLE' THEN 85 WHEN 'VOLATILE' THEN 83 ELSE 70 END"
# What an alliance's events add to its health of 70, and the names of health, trend and risk.
HEALTH_POINTS = (
    ("left_top10", -45), ("entered", 18), ("power_moved AND power_pct >= 25", 20), ("power_moved AND power_pct >= 10 AND power_pct < 25", 10), ("power_moved AND power_pct <= -25", -30),
    ("power_moved AND power_pct <= -10 AND power_pct > -25", -18), ("rank_moved AND rank_gain >= 3", 8), ("rank_moved AND rank_gain <= -3", -12), ("last_ord <> latest", -20),
)
POWER_MOVED, RANK_MOVED = "points >= 2 AND first_total > 0 AND abs(power_pct) >= 5", "points >= 2 AND rank_gain <> 0"


def points_of(rules: tuple, base: int = 0) -> str:
    """``base`` and the points of all rules that hold, kept within 0 and 100."""
    return f"greatest(0, least(100, {base} + " + " + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for c, p in rules) + "))"


HEALTH = points_of(HEALTH_POINTS, 70)
HEALTH_STATUS = graded("health", ((85, "Excellent"), (70, "Healthy"), (50, "Unstable"), (30, "Declining"), (None, "Critical")))
HEALTH_RISK = graded("health", ((75, "LOW"), (50, "MEDIUM"), (None, "HIGH")))
HEALTH_TREND = "CASE WHEN NOT power_moved THEN 'Stable' WHEN power_pct >= 15 THEN 'Growing' WHEN power_pct <= -15 THEN 'Declining' ELSE 'Mixed' END"
# Points of priority and of confidence (from 40) of a recruitment target.
PRIORITY_POINTS = (
    ("health < 30", 40, 20), ("health >= 30 AND health < 50", 25, 15), ("health >= 50 AND health < 70", 10, 8), ("health_status = 'Critical'", 20, 15), ("health_status = 'Declining'", 10, 10),
    ("health_trend = 'Declining'", 15, 10), ("health_trend = 'Mixed'", 5, 0), ("health_risk = 'HIGH'", 15, 10), ("health_risk = 'MEDIUM'", 5, 0), ("overall_score >= 55", 10, 5), ("player_score >= 65", 10, 5),
)
PRIORITY = points_of(tuple((c, p) for c, p, _ in PRIORITY_POINTS))
PRIORITY_CONFIDENCE = points_of(tuple((c, q) for c, _, q in PRIORITY_POINTS), 40)
ACTION = graded("priority", ((85, "Contact immediately"), (70, "High priority"), (50, "Monitor closely"), (30, "Watch"), (None, "Ignore")))
# Weighted rules about a server as (name, condition, points, pieces of evidence).
RULES = (
    ("Alliance left Top10", "left_top10_count > 0", 25, "left_top10_count"), ("Large power loss", "large_power_loss_count > 0", 25, "large_power_loss_count"), ("High volatility", "volatility >= 8", 20, "1"),
    ("Server still relevant", "overall >= 55", 15, "1"), ("Strong player base", "player >= 65", 15, "1"), ("Low quality penalty", "overall < 40 AND player < 65", -25, "2"),
    ("Stable growing server penalty", "growth >= 10 AND volatility < 8", -20, "2"),
)
#: Rules of one's own may be passed to :func:`recruitment_rules` and :func:`insights` in place of these.
# Insights about a server as (title, category, condition, priority, confidence).
INSIGHTS = (
    ("Strong Server", "GROWTH", "overall >= 70 AND growth >= 10", "MEDIUM", 94), ("Internal Restructuring", "RISK", "left_top10_count >= 2 AND critical_alliances >= 2", "HIGH", 96),
    ("Recruitment Opportunity", "RECRUITMENT", "immediate_targets >= 2", "HIGH", 92), ("Alliance Growth", "COMPETITION", "large_power_gain_count >= 2", "MEDIUM", 90), ("High Volatility", "RISK", "volatility >= 10", "MEDIUM", 88),
    ("Weak Server", "RISK", "overall < 40", "HIGH", 87), ("Healthy Environment", "STABILITY", "critical_alliances = 0 AND growth >= 10 AND volatility < 8", "LOW", 91),
)
IMPACT = "CASE priority WHEN 'CRITICAL' THEN 95 WHEN 'HIGH' THEN 82 WHEN 'MEDIUM' THEN 58 ELSE 25 END"


def server_scores(ally: DataFrame, hero: DataFrame, top: int = 10) -> DataFrame:
    """The five scores of every server and their weighted mean; missing data counts as 0."""
    best = ally.where(F.col("rank") <= top)
    totals = best.groupBy("server", "ord").agg(F.sum("value").alias("total"))
    line = totals.groupBy("server").agg(
        F.count("*").alias("points"), F.min_by("total", "ord").alias("first_total"), F.max_by("total", "ord").alias("last_total"), F.max("ord").alias("last_ord"),
        F.stddev_pop("total").alias("sd"), (F.sum("total").cast("double") / F.count("*")).alias("mean"),
    )
    line = line.withColumn("growth_pct", F.expr(PCT)).withColumn("volatility", F.expr("CASE WHEN mean > 0 THEN sd / mean * 100 ELSE 100.0e0 END"))
    last = best.join(line.select("server", F.col("last_ord").alias("ord")), ["server", "ord"])
    place = F.row_number().over(W.partitionBy("server").orderBy("value", "entity"))
    depth = last.withColumn("i", place).groupBy("server").agg(
        F.count("*").alias("alliances"), F.sum(F.col("i") * F.col("value")).alias("iv"), F.sum("value").alias("v"),
        F.sum(F.when(F.col("rank") == 1, F.col("value"))).alias("top1"), F.sum(F.when(F.col("rank") <= 3, F.col("value"))).alias("top3"),
    )
    depth = depth.withColumn("gini", F.expr("2.0e0 * iv / (alliances * CAST(v AS DOUBLE)) - (alliances + 1.0e0) / alliances"))
    newest = hero.groupBy("server").agg(F.max("ord").alias("ord"))
    players = hero.where(F.col("rank") <= top).join(newest, ["server", "ord"]).groupBy("server").agg(
        F.count("*").alias("players"), (F.sum("value").cast("double") / F.count("*")).alias("mean_thp"), F.median("value").alias("median_thp"),
        F.count_if(F.col("value") >= 300e6).alias("elite_300"), F.count_if(F.col("value") >= 320e6).alias("elite_320"), F.count_if(F.col("value") >= 350e6).alias("elite_350"),
    )
    joined = line.join(depth, "server", "left").join(players, "server", "left").fillna({"alliances": 0, "players": 0})
    scored = joined
    for name, rule in (("growth_score", GROWTH), ("power_score", POWER), ("depth_score", DEPTH), ("player_score", PLAYER), ("stability_score", STABILITY)):
        scored = scored.withColumn(name, F.expr(rule).cast("double"))
    scored = scored.fillna(0.0, list(WEIGHTS)).withColumn("overall_score", F.expr(OVERALL).cast("double"))
    return scored


def alliance_profile(ally: DataFrame, top: int = 10) -> DataFrame:
    """Per server and alliance: first and last standing, changes, volatility, trend and health."""
    best = ally.where(F.col("rank") <= top)
    span = best.groupBy("server").agg(F.min("ord").alias("first_seen"), F.max("ord").alias("latest"))
    w = W.partitionBy("server", "entity").orderBy("ord")
    before = F.lag("value").over(w)
    steps = best.withColumn("step_pct", F.when(before > 0, (F.col("value") - before) * F.lit(100.0) / before))
    one = steps.groupBy("server", "entity").agg(
        F.count("*").alias("points"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min_by("value", "ord").alias("first_total"),
        F.max_by("value", "ord").alias("last_total"), F.min_by("rank", "ord").alias("first_rank"), F.max_by("rank", "ord").alias("last_rank"),
        F.round(F.coalesce(F.max("step_pct"), F.lit(0.0)), 4).alias("max_gain"), F.round(F.coalesce(F.min("step_pct"), F.lit(0.0)), 4).alias("max_drop"),
        F.round(F.coalesce(F.avg(F.abs("step_pct")), F.lit(0.0)), 4).alias("volatility"),
    )
    out = one.join(span, "server").withColumns(
        {"power_pct": F.round(F.expr(PCT), 4), "rank_gain": F.col("first_rank") - F.col("last_rank"), "left_top10": F.col("last_ord") != F.col("latest"),
         "entered": (F.col("first_ord") == F.col("latest")) & (F.col("latest") > F.col("first_seen"))}
    ).withColumns({"power_moved": F.expr(POWER_MOVED), "rank_moved": F.expr(RANK_MOVED)})
    for name, rule in (("trend", TREND), ("trend_confidence", TREND_CONFIDENCE), ("health", HEALTH), ("health_status", HEALTH_STATUS), ("health_risk", HEALTH_RISK), ("health_trend", HEALTH_TREND)):
        out = out.withColumn(name, F.expr(rule))
    return out


def alliance_events(profile: DataFrame) -> DataFrame:
    """(server, entity, event_type, severity, confidence): one row per event, by an array of possible events per alliance."""
    event = lambda kind, when, severity, confidence: F.when(F.expr(when), F.struct(F.lit(kind).alias("event_type"), F.expr(severity).alias("severity"), F.lit(confidence).alias("confidence")))
    possible = F.array_compact(
        F.array(
            event("LEFT_TOP10", "left_top10", "'HIGH'", 90), event("ENTERED_TOP10", "entered", "CASE WHEN last_rank <= 5 THEN 'HIGH' ELSE 'MEDIUM' END", 90),
            event("RANK_CHANGED", "rank_moved", RANK_SEVERITY, 85), event("POWER_CHANGED", "power_moved", POWER_SEVERITY, 85),
        )
    )
    return profile.select("server", "entity", F.explode(possible).alias("e")).select("server", "entity", "e.*")


def with_priority(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """Alliances with priority, action and target_confidence."""
    joined = profile.join(scores.select("server", "overall_score", "player_score", "growth_pct", F.col("volatility").alias("server_volatility")), "server")
    return joined.withColumn("priority", F.expr(PRIORITY)).withColumn("target_confidence", F.expr(PRIORITY_CONFIDENCE)).withColumn("action", F.expr(ACTION))


def recruitment_targets(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """Priority, confidence and action per alliance; alliances of priority 0 are dropped."""
    return with_priority(profile, scores).where("priority > 0")


def signal_context(alliances: DataFrame) -> DataFrame:
    """One row per server: counters of events, health and targets, from alliances of :func:`with_priority` in one aggregation."""
    severity = {"rank_moved": RANK_SEVERITY, "power_moved": POWER_SEVERITY, "entered": "CASE WHEN last_rank <= 5 THEN 'HIGH' ELSE 'MEDIUM' END", "left_top10": "'HIGH'"}

    def of(*names: str) -> str:
        listed = ", ".join(f"'{n}'" for n in names)
        return "sum(" + " + ".join(f"CASE WHEN {when} AND {rule} IN ({listed}) THEN 1 ELSE 0 END" for when, rule in severity.items()) + ")"

    n = lambda when: f"count_if({when})"
    columns = {
        "event_count": of("CRITICAL", "HIGH", "MEDIUM", "LOW"), "critical_events": of("CRITICAL"), "high_impact_events": of("CRITICAL", "HIGH"), "medium_impact_events": of("MEDIUM"), "low_impact_events": of("LOW"),
        "left_top10_count": n("left_top10"), "entered_top10_count": n("entered"), "power_change_count": n("power_moved"), "large_power_loss_count": n("power_moved AND power_pct <= -10"),
        "large_power_gain_count": n("power_moved AND power_pct >= 15"), "rank_change_count": n("rank_moved"), "alliance_count": "count(1)",
        **{f"{x.lower()}_alliances": n(f"health_status = '{x}'") for x in ("Critical", "Declining", "Unstable", "Healthy", "Excellent")}, **{f"{x.lower()}_risk_alliances": n(f"health_risk = '{x}'") for x in ("HIGH", "MEDIUM", "LOW")},
        "recruitment_target_count": n("priority > 0"), "immediate_targets": n("action = 'Contact immediately'"), "high_priority_targets": n("action = 'High priority'"), "watch_targets": n("priority > 0 AND action = 'Watch'"),
        **{x.lower(): n(f"trend = '{x}'") for x in ("COLLAPSING", "GROWING", "DECLINING", "RECOVERING")}, "weak": n("health < 50"), "strong": n("health >= 80"),
        "overall": "max(overall_score)", "player": "max(player_score)", "growth": "max(growth_pct)", "volatility": "max(server_volatility)",
    }
    return alliances.groupBy("server").agg(*[F.expr(e).alias(c) for c, e in columns.items()])


def recruitment_rules(signals: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Score, confidence and number of matched rules of every server."""
    hits = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c, _, _ in rules)
    evidence = " + ".join(f"CASE WHEN {c} THEN {e} ELSE 0 END" for _, c, _, e in rules)
    score = points_of(tuple((c, p) for _, c, p, _ in rules))
    return signals.select("server", F.expr(score).alias("score"), F.expr(f"least(15 * ({hits}), 60) + least(8 * ({evidence}), 40)").alias("confidence"), F.expr(hits).alias("matched"))


def insights(signals: DataFrame, rules: tuple = INSIGHTS) -> DataFrame:
    """(server, title, category, priority, confidence, impact) of every insight rule that holds."""
    cells = F.array_compact(F.array(*[F.when(F.expr(c), F.struct(F.lit(t).alias("title"), F.lit(g).alias("category"), F.lit(p).alias("priority"), F.lit(q).alias("confidence"))) for t, g, c, p, q in rules]))
    return signals.select("server", F.explode(cells).alias("i")).select("server", "i.*").withColumn("impact", F.expr(IMPACT))
