"""Validation of observations against curated truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions import text as tx
from ladderlake.session import cut

TRIAGE = "CASE WHEN tier = 0 THEN 'missing' WHEN NOT power_ok THEN 'power' WHEN NOT tag_ok THEN 'alliance' WHEN NOT name_ok THEN 'name' ELSE 'clean' END"
PLAN = "CASE triage WHEN 'missing' THEN 'recapture' WHEN 'power' THEN 'reread_power' WHEN 'alliance' THEN 'check_vocabulary' WHEN 'name' THEN 'reread_name' ELSE 'none' END"


def match_cascade(truth: DataFrame, seen: DataFrame) -> DataFrame:
    """Best observation per truth row: same name, else the same power, else the same place in the list of the server.

    ``truth``: truth_id, server, name, tag, power, place; ``seen``: seen_id and
    the same.  Each tier is an equi-join; the best tier wins, then the smallest
    distance in power, then the smallest id.
    """
    t, s = truth.alias("t"), seen.alias("s")
    same = F.col("t.server") == F.col("s.server")
    tiers = [
        (1, same & (F.lower("t.name") == F.lower("s.name"))),
        (2, same & (F.col("t.power") == F.col("s.power"))),
        (3, same & (F.col("t.place") == F.col("s.place"))),
    ]
    found = None
    for tier, on in tiers:
        hit = t.join(s, on).select("t.truth_id", "s.seen_id", F.lit(tier).alias("tier"), F.abs(F.col("t.power") - F.col("s.power")).alias("off"))
        found = hit if found is None else found.unionByName(hit)
    w = W.partitionBy("truth_id").orderBy("tier", F.asc_nulls_last("off"), "seen_id")
    best = found.withColumn("n", F.row_number().over(w)).where("n = 1").select("truth_id", "seen_id", "tier")
    return truth.select("truth_id").join(best, "truth_id", "left").withColumn("tier", F.coalesce("tier", F.lit(0)))


def detail(truth: DataFrame, seen: DataFrame) -> DataFrame:
    """One row per truth row with the flags of its match."""
    m = match_cascade(truth, seen)
    t = truth.select("truth_id", F.col("name").alias("t_name"), F.col("tag").alias("t_tag"), F.col("power").alias("t_power"), F.col("place").alias("t_place"), "server")
    s = seen.select("seen_id", F.col("name").alias("s_name"), F.col("tag").alias("s_tag"), F.col("power").alias("s_power"), F.col("place").alias("s_place"))
    j = m.join(t, "truth_id").join(s, "seen_id", "left")
    return j.withColumns(
        {
            "power_match": tx.compare_power(F.col("t_power"), F.col("s_power")),
            "tag_ok": F.coalesce(F.lower("t_tag") == F.lower("s_tag"), F.col("t_tag").isNull() & F.col("s_tag").isNull()),
            "name_ok": F.coalesce(F.col("t_name") == F.col("s_name"), F.lit(False)),
            "rank_ok": F.coalesce(F.col("t_place") == F.col("s_place"), F.lit(False)),
        }
    ).withColumn("power_ok", F.col("power_match").isin("exact", "near", "insert_zero", "scale_x10_truncated_digit")).withColumn("triage", F.expr(TRIAGE)).withColumn("plan", F.expr(PLAN))


def metrics(details: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, precision, recall, F1 of the rounded two, and the weighted score (fixed weights; names count by equality alone)."""
    share = lambda c: F.count_if(F.col(c)) * 1.0 / F.count("*")
    g = details.groupBy(*keys).agg(
        F.count("*").alias("truth_rows"), F.count_if(F.col("tier") > 0).alias("matched"), F.count_if((F.col("tier") > 0) & F.col("power_ok")).alias("good"),
        share("power_ok").alias("p"), share("rank_ok").alias("r"), share("tag_ok").alias("a"), share("name_ok").alias("n"),
    )
    g = g.withColumn("precision", F.round(F.col("good") / F.greatest("matched", F.lit(1)), 4)).withColumn("recall", F.round(F.col("good") / F.col("truth_rows"), 4))
    f1 = F.round(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), 4)
    score = F.round(100 * (0.15 * F.col("matched") / F.col("truth_rows") + 0.15 * F.col("p") + 0.10 * F.col("r") + 0.20 * F.col("a") + 0.40 * F.col("n")), 2)
    return g.select(*keys, "truth_rows", "matched", "good", "precision", "recall", f1.alias("f1"), score.alias("score"))


def normalize_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(server, tag, known, state, score) of every distinct tag against the known tags of its server, without case.

    exact; else the best of: one edit (at least .92), a subsequence of a known
    tag of three letters (at least .88), a ratio of .82 for tags of three
    letters, named edit, subsequence or ratio, if it is the only one or leads by
    .12.  ambiguous: it does not lead; unmatched: nothing is like it; known is
    null for both.  Known tags that differ in case alone are one, the smallest.
    """
    known = vocabulary.where("known is not null").groupBy("server", F.lower("known").alias("k")).agg(F.min("known").alias("known")).where("length(k) >= 2")
    asked = tags.where("tag is not null").select("server", "tag", F.lower("tag").alias("t")).distinct()
    same = F.col("t") == F.col("k")
    scored = asked.join(known, "server").withColumn("r", F.when(same, F.lit(1.0)).otherwise(tx.ratio("t", "k")))
    letter = lambda acc, c: F.when((acc < F.length("t")) & (F.substring(F.col("t"), acc + 1, F.lit(1)) == c), acc + 1).otherwise(acc)
    inside = F.aggregate(F.split("k", ""), F.lit(0), letter) == F.length("t")
    state = (
        F.when(same, "exact").when(F.levenshtein("t", "k", 1) >= 0, "edit").when((F.length("t") >= 2) & (F.length("k") >= 3) & inside, "subsequence")
        .when((F.length("t") >= 3) & (F.col("r") >= 0.82), "ratio")
    )
    near = scored.withColumn("state", state).where("state is not null").withColumn("score", F.expr("greatest(r, CASE state WHEN 'edit' THEN 0.92D WHEN 'subsequence' THEN 0.88D ELSE 0D END)"))
    w = W.partitionBy("server", "tag").orderBy(F.desc(F.col("state") == "exact"), F.desc("score"), "known")
    top = near.withColumns({"first": F.row_number().over(w), "lead": F.round(F.col("score") - F.lead("score").over(w), 4)}).where("first = 1")
    clear = (F.col("state") == "exact") | F.col("lead").isNull() | (F.col("lead") >= 0.12)
    best = top.select("server", "tag", F.when(clear, F.col("known")).alias("known"), F.when(clear, F.col("state")).otherwise("ambiguous").alias("state"), "score")
    every = asked.select(F.col("server").alias("s"), F.col("tag").alias("g"))
    out = every.join(best, F.col("s").eqNullSafe(F.col("server")) & (F.col("g") == F.col("tag")), "left")
    return out.select(F.col("s").alias("server"), F.col("g").alias("tag"), "known", F.coalesce("state", F.lit("unmatched")).alias("state"), "score")


def power_pairs(truth: DataFrame, seen: DataFrame, near: float, keys: list[str]) -> DataFrame:
    """Every pair equal in ``keys`` whose powers are equal, within ``near``, or within 0.005 after a repair of the seen one; each once.

    Adds ``kind`` and ``p`` (similarity of the powers), ``n`` (of the names) and
    ``a`` (equal tags; two missing tags are no evidence).  Columns of the two
    sides begin with t_ and s_.  A repair is about ten times the power as read,
    so no pair meets both ways.
    """
    bucket = lambda c, width: F.floor(F.log(c) / width)
    key = lambda way, b: F.struct(F.lit(way).alias("way"), b.alias("b"))
    close, power = near * 1.2, F.col("power")
    around = F.array_distinct(F.flatten(F.transform(tx.power_repairs(power), lambda c: F.array(*[bucket(c, tx.REPAIR_WIDTH) + d for d in (-1, 0, 1)]))))
    side = lambda df, letter, at: df.where("power > 0").select(*[c if c in keys else F.col(c).alias(c if c.endswith("_id") else f"{letter}_{c}") for c in df.columns], F.explode(at).alias("k"))
    t = side(truth, "t", F.array(*[key("read", bucket(power, close) + d) for d in (-1, 0, 1)], key("repaired", bucket(power, tx.REPAIR_WIDTH))))
    s = side(seen, "s", F.concat(F.array(key("read", bucket(power, close))), F.transform(around, lambda b: key("repaired", b))))
    met = t.join(s, [*keys, "k"]).drop("k").withColumn("e", tx.power_evidence(F.col("t_power"), F.col("s_power"), near)).where("e is not null")
    met = met.select("*", F.col("e.kind").alias("kind"), F.col("e.similarity").alias("p")).drop("e")
    return met.withColumns({"n": tx.ratio(tx.identity_key("t_name"), tx.identity_key("s_name")), "a": F.coalesce(F.lower("t_tag") == F.lower("s_tag"), F.lit(False))})


def evidence_candidates(truth: DataFrame, seen: DataFrame) -> DataFrame:
    """(truth_id, seen_id, score, kind): the only row of the server with the same power, else the best like one.

    Like rows have a near or repaired power and a similar name or the same tag;
    the best must score 0.72 and lead the next by 0.05.
    """
    apart = F.abs(F.col("t_place") - F.col("s_place"))
    r = F.when(apart == 0, 1.0).when(apart <= 3, 0.65).when(apart <= 10, 0.25).otherwise(0.0)
    weight = F.when(F.col("kind") == "exact", 0.72).otherwise(0.62)
    scored = power_pairs(truth, seen, 0.00005, ["server"]).withColumn("score", F.round(F.col("p") * weight + F.col("n") * 0.18 + F.col("a").cast("double") * 0.07 + r * 0.03, 4))
    of_one = W.partitionBy("truth_id")
    kept = scored.withColumn("exacts", F.count_if(F.col("kind") == "exact").over(of_one)).where("CASE WHEN exacts = 1 THEN kind = 'exact' ELSE kind <> 'exact' AND (n >= 0.55 OR a) END")
    w = of_one.orderBy(F.desc("score"), "seen_id")
    top = kept.withColumns({"first": F.row_number().over(w), "lead": F.round(F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)), 4)})
    return top.where("first = 1 AND score >= 0.72 AND lead >= 0.05").select("truth_id", "seen_id", "score", "kind")


def greedy_pairs(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """One-to-one assignment by descending score, ties by the two ids.

    A pair that is the best of both its ends would be taken by a sequential
    greedy pass whatever else is taken before, so all such pairs are taken at
    once and the rest goes into the next round, until none is left.  No group
    is ever brought into one task.
    """
    rest = cut(pairs)
    taken = None
    while True:
        rank = F.struct(F.col(score).alias("s"), (-F.col(left)).alias("l"), (-F.col(right)).alias("r"))
        best_left = rest.groupBy(left).agg(F.max(rank).alias("__best")).select((-F.col("__best.l")).alias(left), (-F.col("__best.r")).alias(right))
        best_right = rest.groupBy(right).agg(F.max(rank).alias("__best")).select((-F.col("__best.l")).alias(left), (-F.col("__best.r")).alias(right))
        won = cut(rest.join(best_left, [left, right], "left_semi").join(best_right, [left, right], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        rest = cut(rest.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti"))
        if rest.isEmpty():
            return taken
