"""Character evidence: what several readings of one place say about each position of a name.

Observations are counted per place, position and character before anything
else; confidences are kept as whole hundredths, so sums do not depend on the
order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLACE = ["server", "captured_on", "slot"]
# a billionth settles ties of the last decimal alike in every engine
SHARE = "n * 1.0e0 / total"
MEAN = "points * 0.01e0 / n"
CONSENSUS = "round(0.38e0 * mean_confidence + 0.27e0 * share + 0.20e0 * CASE WHEN pos <= usual_length THEN 1 ELSE 0 END + 0.15e0 * CASE WHEN n >= 2 THEN 1 ELSE 0 END + 1e-9, 4)"
CONSENSUS_CLASS = "CASE WHEN consensus >= 0.80 THEN 'STRONG' WHEN consensus >= 0.60 THEN 'FAIR' ELSE 'WEAK' END"
RISK = "round(0.35e0 * CASE WHEN share < 0.5 THEN 1 ELSE 0 END + 0.30e0 * (1 - mean_confidence) + 0.20e0 * CASE WHEN pos <= usual_length THEN 0 ELSE 1 END + 0.15e0 * CASE WHEN total = 1 THEN 1 ELSE 0 END + 1e-9, 4)"
RISK_CLASS = "CASE WHEN risk >= 0.70 THEN 'CRITICAL' WHEN risk >= 0.50 THEN 'HIGH' WHEN risk >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END"
MAP = "CASE WHEN chars > 1 AND share < 0.5 THEN 'CONFLICT' WHEN ch IN (' ', '_', '-', '.') THEN 'CONFIRMED' WHEN share >= 0.6 AND total >= 2 THEN 'CONFIRMED' WHEN total >= 1 THEN 'UNRESOLVED' ELSE 'MISSING' END"
STAGE = "CASE WHEN total = 0 THEN 'screenshot' WHEN pos > usual_length THEN 'crop' WHEN mean_confidence < 0.6 THEN 'ocr' WHEN share < 0.5 THEN 'vote' WHEN chars > 1 THEN 'reconstruction' ELSE 'none' END"
BRIDGE = "CASE WHEN chars = 1 AND total >= 2 THEN 'DIRECT' WHEN share >= 0.6 THEN 'BRIDGED' WHEN chars > 1 AND share < 0.5 THEN 'CONFLICTING' WHEN total = 1 AND mean_confidence < 0.6 THEN 'UNSAFE_REJECTED' ELSE 'AMBIGUOUS' END"
CLEARANCE = "CASE WHEN conflicts = 0 AND weakest >= 0.6 THEN 'CLEAR' WHEN conflicts = 1 THEN 'STRIKE_I' WHEN conflicts = 2 THEN 'STRIKE_II' WHEN conflicts > 2 THEN 'STRIKE_III' ELSE 'REVIEW' END"
READINESS = "CASE WHEN coverage >= 0.75 AND mean_consensus >= 0.78 THEN 'READY' WHEN coverage >= 0.75 AND mean_consensus >= 0.72 THEN 'REVIEW_READY' ELSE 'NOT_READY' END"


def observations(fragments: DataFrame) -> DataFrame:
    """(place, fragment_id, pos, ch, cp) of every readable character."""
    f = fragments.select(*PLACE, "fragment_id", F.col("raw_player_name").alias("text"), F.round(F.coalesce("confidence", F.lit(0.5)) * 100).cast("bigint").alias("cp")).dropDuplicates(["fragment_id"])
    f = f.where("text rlike '[\\\\p{L}\\\\p{N}]'")
    pos = F.explode(F.sequence(F.lit(1), F.length("text"))).alias("pos")
    return f.select("*", pos).select(*PLACE, "fragment_id", "pos", F.substring(F.col("text"), F.col("pos"), F.lit(1)).alias("ch"), "cp")


def positions(obs: DataFrame) -> DataFrame:
    """The winning character of each position with its share, confidence, risk and states."""
    votes = obs.groupBy(*PLACE, "pos", "ch").agg(F.count("*").alias("n"), F.sum("cp").alias("points"))
    where = W.partitionBy(*PLACE, "pos")
    ranked = votes.withColumn("total", F.sum("n").over(where)).withColumn("chars", F.count("*").over(where)).withColumn("place_no", F.row_number().over(where.orderBy(F.desc("n"), F.desc("points"), "ch")))
    top = ranked.where("place_no = 1").drop("place_no")
    lengths = obs.groupBy(*PLACE, "fragment_id").agg(F.max("pos").alias("length")).groupBy(*PLACE, "length").agg(F.count("*").alias("k"))
    usual = lengths.groupBy(*PLACE).agg(F.max(F.struct("k", "length")).alias("m")).select(*PLACE, F.col("m.length").alias("usual_length"))
    out = top.join(usual, PLACE)
    for name, rule in (("share", SHARE), ("mean_confidence", MEAN), ("consensus", CONSENSUS), ("risk", RISK), ("state", MAP), ("failed_stage", STAGE), ("bridge", BRIDGE)):
        out = out.withColumn(name, F.expr(rule))
    return out


def places(pos: DataFrame) -> DataFrame:
    """Composition, clearance and readiness of each place."""
    g = pos.groupBy(*PLACE).agg(
        F.count("*").alias("positions"), F.count_if(F.col("state") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("state") == "CONFLICT").alias("conflicts"), F.min("share").alias("weakest"),
        F.sum(F.round(F.col("consensus") * 10000).cast("bigint")).alias("c"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("composed"),
    )
    g = g.withColumn("coverage", F.round(F.col("confirmed") / F.col("positions"), 4)).withColumn("mean_consensus", F.round(F.col("c") / F.col("positions") / 10000, 4)).drop("c")
    return g.withColumn("clearance", F.expr(CLEARANCE)).withColumn("readiness", F.expr(READINESS))
