"""Guards that part trustworthy rows from quarantined ones, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The limits and points of the guards.
HERO_FIT = "CASE WHEN power BETWEEN 1000000 AND 1000000000 THEN 60 ELSE 0 END + CASE WHEN player_name IS NOT NULL THEN 40 ELSE 0 END"
ALLY_FIT = "CASE WHEN power > 1000000000 THEN 60 ELSE 0 END + CASE WHEN player_name IS NULL THEN 40 ELSE 0 END"
VERDICT = "CASE WHEN power IS NULL THEN 'placeholder' WHEN fit >= 60 THEN 'pass' WHEN fit >= 40 THEN 'calibrated_pass' ELSE 'quarantine' END"
SANITY = (
    "CASE WHEN power IS NULL THEN 'missing' WHEN power <= 0 THEN 'quarantine_nonpositive' WHEN median_power > 0 AND power > 3 * median_power AND rank > 3 THEN 'quarantine_high' "
    "WHEN median_power > 0 AND power < median_power / 5e0 THEN 'quarantine_low' WHEN previous_power IS NOT NULL AND power > 1.5 * previous_power THEN 'review_order' ELSE 'pass' END"
)
FIDELITY = "CASE WHEN rank_warning IS NOT NULL AND server_warning IS NOT NULL THEN 'high' WHEN rank_warning IS NOT NULL OR server_warning IS NOT NULL OR name IS NULL THEN 'medium' ELSE 'low' END"
VISIBLE = "CASE WHEN ocr_rank IS NOT NULL AND ocr_rank = rank THEN 'explicit' WHEN ocr_rank IS NOT NULL THEN 'conflict' WHEN rank IS NOT NULL THEN 'derived' ELSE 'source_row_only' END"


def server_assignment(rows: DataFrame, least: int = 3) -> DataFrame:
    """Server of a snapshot by the vote of its rows' file names against the one in the metadata."""
    vote = F.regexp_extract(F.col("source_file"), r"(?:^|s)([0-9]{3,4})[-_@]", 1)
    votes = rows.where(vote != "").groupBy("snapshot_id", vote.cast("int").alias("voted")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("snapshot_id").agg(F.max(F.struct("votes", (-F.col("voted")).alias("m"))).alias("b")).select("snapshot_id", (-F.col("b.m")).alias("voted"), F.col("b.votes").alias("votes"))
    meta = rows.groupBy("snapshot_id").agg(F.min("server").alias("server"))
    decided = F.when(F.col("votes") >= least, F.col("voted")).otherwise(F.col("server"))
    return meta.join(best, "snapshot_id", "left").select("snapshot_id", "server", decided.alias("assigned"), F.coalesce(F.col("votes") >= least, F.lit(False)).alias("by_vote"), (decided != F.col("server")).alias("conflict"))


def ranking_guard(rows: DataFrame) -> DataFrame:
    """Semantic fit of each row to its ranking; a quarantined row leaves a placeholder in its lane."""
    fit = F.when(F.col("ranking_type") == "total_hero_power", F.expr(HERO_FIT)).otherwise(F.expr(ALLY_FIT))
    judged = rows.withColumn("fit", fit).withColumn("verdict", F.expr(VERDICT))
    bad = F.col("verdict") == "quarantine"
    copies: Column = F.when(bad, F.array(F.struct(F.lit("operational").alias("out_lane"), F.lit(None).cast("bigint").alias("out_power")), F.struct(F.lit("ranking_guard_quarantine").alias("out_lane"), F.col("power").alias("out_power")))).otherwise(
        F.array(F.struct(F.col("lane").alias("out_lane"), F.col("power").alias("out_power")))
    )
    return judged.select("row_id", "fit", "verdict", F.explode(copies).alias("c")).select("row_id", "fit", "verdict", "c.*")


def power_sanity(rows: DataFrame) -> DataFrame:
    """Envelope rules against the median of the row's own screen and the row before it."""
    screen = W.partitionBy("snapshot_id", "source_file")
    order = screen.orderBy("rank", "row_id")
    wide = rows.withColumn("median_power", F.percentile("power", 0.5).over(screen)).withColumn("previous_power", F.lag("power").over(order))
    return wide.withColumn("decision", F.expr(SANITY))


def explosion_set(rows: DataFrame, factor: float = 2.5) -> DataFrame:
    """Rows whose power exceeds ``factor`` times everything before them on their screen, though ranked lower."""
    before = W.partitionBy("snapshot_id", "source_file").orderBy("rank", "row_id").rowsBetween(W.unboundedPreceding, -1)
    return rows.where("power > 0").withColumn("most_before", F.max("power").over(before)).where(F.col("power") > factor * F.col("most_before")).select("row_id", "power", "most_before")


def power_candidates(power: Column) -> Column:
    """Repairs of a power that was read wrongly: a digit lost at the end, an inner zero lost, a leading digit lost.

    Repairs beyond the range of a 64-bit integer are left out.
    """
    s = power.cast("string")
    zeros = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i), F.lit("0"), F.substring(s, i + 1, F.lit(20))).try_cast("bigint"))
    ends = F.transform(F.array(F.lit("0"), F.lit("00")), lambda d: F.concat(s, d).try_cast("bigint"))
    heads = F.transform(F.array(*[F.lit(d) for d in "1234"]), lambda d: F.concat(d, s).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(ends, zeros, heads))))


def content_blocks(rows: DataFrame, small: int = 20, large: int = 25, least: float = 0.72) -> DataFrame:
    """Small blocks of a list whose content lies within a large block of another server at the same capture day."""
    block = rows.where("power > 0").groupBy("server", "ranking_type", F.to_date("captured_at").alias("day")).agg(
        F.count("*").alias("n"), F.min("power").alias("lo"), F.max("power").alias("hi"), F.collect_set("alliance_tag").alias("tags"),
        F.round(F.sum(F.round(F.col("server_confidence") * 100).cast("bigint")) / F.count("server_confidence") / 100, 6).alias("confidence"),
    )
    s, b = block.where(F.col("n") <= small).alias("s"), block.where(F.col("n") >= large).alias("b")
    inside = F.when((F.col("s.lo") >= F.col("b.lo")) & (F.col("s.hi") <= F.col("b.hi")), 1.0).otherwise(0.0)
    overlap = F.when(F.size("s.tags") > 0, F.size(F.array_intersect("s.tags", "b.tags")) / F.size("s.tags")).otherwise(0.0)
    score = F.round(0.45 * inside + 0.35 * overlap + 0.10 * F.least(F.col("b.n") / F.col("s.n") / 10.0, F.lit(1.0)) + F.when(F.coalesce(F.col("s.confidence"), F.lit(1.0)) < 0.75, 0.10).otherwise(0.0), 4)
    # without a common tag a pair stays below ``least``, so blocks meet by tag
    key = ["ranking_type", "day"]
    tagged = lambda x, n: x.select(*[F.col(f"{n}.{c}") for c in key], F.col(f"{n}.server").alias(f"{n}_server"), F.explode(f"{n}.tags").alias("tag"))
    met = tagged(s, "s").join(tagged(b, "b"), [*key, "tag"]).where("s_server <> b_server").select(*key, "s_server", "b_server").distinct()
    on = lambda n: (F.col("m.ranking_type") == F.col(f"{n}.ranking_type")) & (F.col("m.day") == F.col(f"{n}.day")) & (F.col(f"m.{n}_server") == F.col(f"{n}.server"))
    pair = met.alias("m").join(s, on("s")).join(b, on("b"))
    scored = pair.select(F.col("s.server").alias("server"), F.col("s.ranking_type").alias("ranking_type"), F.col("s.day").alias("day"), F.col("b.server").alias("target"), score.alias("score"))
    w = W.partitionBy("server", "ranking_type", "day").orderBy(F.desc("score"), "target")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") == 1).drop("n").where(F.col("score") >= least)
