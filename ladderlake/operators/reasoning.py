"""Facts, indicators, hypotheses and assessments drawn from snapshot differences.

All rules are expressions in SQL text over one row of counters per board and
date; powers are in millions, as the boards deliver them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The limits, points and weights of all rules in this module.
WHALE = 220.0
DELTA = "CASE WHEN old_power > 0 THEN (new_power - old_power) / old_power END"
FACT_SEVERITY = "CASE WHEN abs(delta) >= 0.25 THEN 'CRITICAL' WHEN abs(delta) >= 0.15 THEN 'HIGH' ELSE 'MEDIUM' END"
SEVERITY_RANK = "CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"
WHALE_SEVERITY = "CASE WHEN n >= 3 THEN 'CRITICAL' WHEN n = 2 THEN 'HIGH' ELSE 'MEDIUM' END"
DECLINE_POINTS = "CASE WHEN delta <= -0.25 THEN 35 WHEN delta <= -0.15 THEN 20 WHEN delta <= -0.08 THEN 10 ELSE 0 END + CASE WHEN difference_type = 'Moved' AND delta <= -0.08 THEN 10 ELSE 0 END"
COUNTERS = {
    "added": "difference_type = 'Added'", "removed": "difference_type = 'Removed'", "moved": "difference_type = 'Moved'", "modified": "difference_type = 'Modified'",
    "whales_in": f"difference_type = 'Added' AND new_power >= {WHALE}", "whales_out": f"difference_type = 'Removed' AND old_power >= {WHALE}",
    "growth": "delta >= 0.08", "decline": "delta <= -0.08",
}
#: Indicators, hypotheses and assessments: name to expression over the counters, each may use the ones before it.
RULES = {
    "whale_balance": "whales_in - whales_out",
    "transfer_activity": "least(100, 35 * CASE WHEN moved > 0 THEN 1 ELSE 0 END + 25 * CASE WHEN added > 0 THEN 1 ELSE 0 END + 25 * CASE WHEN removed > 0 THEN 1 ELSE 0 END)",
    "alliance_stability": "100 - 30 * CASE WHEN moved > 0 THEN 1 ELSE 0 END - 25 * CASE WHEN decline > 0 THEN 1 ELSE 0 END",
    "strategic_risk": "35 * CASE WHEN decline >= 2 THEN 1 ELSE 0 END + 25 * CASE WHEN whales_out > 0 THEN 1 ELSE 0 END + 30 * CASE WHEN health < 60 THEN 1 ELSE 0 END",
    "recruitability": "least(100, 20 * moved + 10 * removed + 15 * decline)",
    "talent": "least(100, 8 * whales_in + 4 * growth + 2 * added)",
    "collapse": "25 * decline + 15 * whales_out + CASE WHEN health > 0 AND health <= 60 THEN 30 ELSE 0 END",
    "collapse_confidence": "CASE WHEN collapse >= 35 THEN least(60 + 0.4 * collapse, 95) END",
    "window_score": "0.45 * recruitability + 0.35 * talent + 12 * decline",
    "window_confidence": "CASE WHEN window_score >= 45 THEN least(65 + 0.3 * window_score, 96) END",
    "strength": "20 * greatest(growth - decline, 0) + 20 * greatest(whale_balance, 0)",
    "strength_confidence": "CASE WHEN strength >= 35 THEN least(60 + 0.35 * strength, 95) END",
    "assess_window": "0.55 * coalesce(window_confidence, 0) + 0.25 * recruitability + 0.15 * talent + least(5 * decline, 15)",
    "assess_collapse": "0.48 * coalesce(collapse_confidence, 0) + 0.28 * coalesce(window_confidence, 0) + CASE WHEN health < 45 THEN 18 WHEN health < 65 THEN 35 * 0.7 ELSE 0 END + least(7 * decline, 28) + least(9 * whales_out, 24) + least(10 * removed, 22)",
    "assess_strength": "0.65 * coalesce(strength_confidence, 0) + least(12 * growth, 30) + least(10 * greatest(whale_balance, 0), 20)",
    "opportunity": "least(0.55 * recruitability + 0.25 * greatest(0, 100 - health) + 8 * whales_out + 10 * decline, 100)",
}
LEVEL = "CASE WHEN {x} >= 80 THEN 'HIGH' WHEN {x} >= 55 THEN 'ELEVATED' WHEN {x} >= 25 THEN 'MODERATE' ELSE 'LOW' END"
COLLAPSE_SEVERITY = "CASE WHEN assess_collapse >= 90 THEN 'CRITICAL' WHEN assess_collapse >= 70 THEN 'HIGH' ELSE 'MEDIUM' END"
SELECTED = (
    "CASE WHEN coalesce(collapse_confidence, 0) = 0 AND coalesce(window_confidence, 0) = 0 AND coalesce(strength_confidence, 0) = 0 THEN 'NONE' "
    "WHEN coalesce(collapse_confidence, 0) >= coalesce(window_confidence, 0) AND coalesce(collapse_confidence, 0) >= coalesce(strength_confidence, 0) THEN 'COLLAPSE' "
    "WHEN coalesce(window_confidence, 0) >= coalesce(strength_confidence, 0) THEN 'RECRUITMENT_WINDOW' ELSE 'STRENGTH' END"
)
STATUS = "CASE WHEN strategic_risk >= 60 THEN 'Critical' WHEN alliance_stability < 60 THEN 'Unstable' WHEN transfer_activity >= 60 THEN 'Active' ELSE 'Stable' END"
PRIORITY = "CASE WHEN opportunity >= 85 THEN 'CRITICAL' WHEN opportunity >= 65 THEN 'HIGH' ELSE 'MEDIUM' END"
VALUE = "0.40 * talent + 0.25 * (100 - health) * recruitability / 100 + 0.20 * least(5 * whales_out, 100) + 0.10 * (0.6 * recruitability + 0.4 * transfer_activity) + 0.05 * growth"


def flat_differences(diffs: DataFrame) -> DataFrame:
    """Differences with old and new values as columns and the relative change of power."""
    flat = [F.col(f"payload.{s}.{c}").alias(f"{s}_{c}") for s in ("old", "new") for c in ("name", "server", "alliance", "power")]
    return diffs.select("board", "from_date", "to_date", "identifier", "difference_type", *flat).withColumn("delta", F.expr(DELTA))


def counters(flat: DataFrame) -> DataFrame:
    """One row per board and date: counts of kinds of differences and the structural health."""
    points = F.sum(F.expr(DECLINE_POINTS).cast("bigint"))
    return flat.groupBy("board", "to_date").agg(
        *[F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()], F.greatest(F.lit(0), F.lit(100) - F.coalesce(points, F.lit(0))).cast("bigint").alias("health")
    )


def judge(counts: DataFrame) -> DataFrame:
    """All indicators, hypotheses and assessments of every board and date."""
    out = counts
    for name, rule in RULES.items():
        out = out.withColumn(name, F.round(F.expr(rule).cast("double"), 4))
    return out


def growth_facts(flat: DataFrame) -> DataFrame:
    """Facts about changes of power of 8 percent and more; the id is a hash of what the fact says."""
    facts = flat.where("abs(delta) >= 0.08").withColumn("severity", F.expr(FACT_SEVERITY)).select(
        F.lit("growth").alias("source"), F.when(F.col("delta") > 0, "Power gain").otherwise("Power loss").alias("title"), "severity", F.lit("player").alias("entity_type"),
        F.col("identifier").alias("entity_id"), "board", "to_date", F.round("delta", 4).alias("delta"), F.coalesce("new_alliance", F.lit("none")).alias("tag"),
    )
    return facts.withColumn("fact_id", F.sha2(F.concat_ws("|", "source", "title", "entity_type", "entity_id", "board", "to_date"), 256))


def publish(facts: DataFrame) -> DataFrame:
    """Facts without blank title or source, each once."""
    return facts.where("trim(title) <> '' and trim(source) <> ''").dropDuplicates(["fact_id"])
