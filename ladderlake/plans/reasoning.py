"""Snapshot differences, facts and what follows from them as named queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.operators import reasoning as rs
from ladderlake.operators.snapshot_delta import differences_at_once
from ladderlake.plans import dq
from ladderlake.plans.base import Book, Frames

B = Book()
_D = dq._P7 + f", d0 AS (SELECT board, strftime(f, '%Y-%m-%d') AS from_date, strftime(t, '%Y-%m-%d') AS to_date, identifier, difference_type, old_name, old_server, old_alliance, old_power, new_name, new_server, new_alliance, new_power FROM j WHERE difference_type IS NOT NULL), d AS (SELECT *, {rs.DELTA} AS delta FROM d0)\n"
_POINTS = "(CASE WHEN delta > -0.08 THEN 0 WHEN delta > -0.15 THEN 10 WHEN delta > -0.25 THEN 20 WHEN delta <= -0.25 THEN 35 ELSE 0 END + 10 * coalesce(difference_type = 'Moved' AND delta <= -0.08, false)::INT)"
_C = _D + f""", c AS (SELECT board, to_date, sum((difference_type = 'Added')::INT) AS added, sum((difference_type = 'Removed')::INT) AS removed, sum((difference_type = 'Moved')::INT) AS moved, sum((difference_type = 'Modified')::INT) AS modified,
  count(*) FILTER (difference_type = 'Added' AND new_power >= 220) AS whales_in, count(*) FILTER (difference_type = 'Removed' AND old_power >= 220) AS whales_out, count(*) FILTER (delta >= 0.08) AS growth, count(*) FILTER (delta <= -0.08) AS decline,
  CAST(greatest(0, 100 - sum({_POINTS})) AS BIGINT) AS health FROM d GROUP BY board, to_date)
"""
# the rules step by step, each rounded to four places
_K = _C + """, k1 AS (SELECT *, (whales_in - whales_out)::DOUBLE AS whale_balance, (35 * (moved > 0)::INT + 25 * (added > 0)::INT + 25 * (removed > 0)::INT)::DOUBLE AS transfer_activity,
  (100 - 30 * (moved > 0)::INT - 25 * (decline > 0)::INT)::DOUBLE AS alliance_stability, (35 * (decline > 1)::INT + 25 * (whales_out > 0)::INT + 30 * (health < 60)::INT)::DOUBLE AS strategic_risk,
  least(100, 20 * moved + 10 * removed + 15 * decline)::DOUBLE AS recruitability, least(100, 8 * whales_in + 4 * growth + 2 * added)::DOUBLE AS talent,
  (25 * decline + 15 * whales_out + 30 * (health BETWEEN 1 AND 60)::INT)::DOUBLE AS collapse FROM c),
 k2 AS (SELECT *, round(CASE WHEN collapse >= 35 THEN least(95, 60 + 0.4::DOUBLE * collapse) END, 4) AS collapse_confidence, round(0.45::DOUBLE * recruitability + 0.35::DOUBLE * talent + 12 * decline, 4) AS window_score FROM k1),
 k3 AS (SELECT *, round(CASE WHEN window_score >= 45 THEN least(96, 65 + 0.3::DOUBLE * window_score) END, 4) AS window_confidence, (20 * greatest(growth - decline, 0) + 20 * greatest(whale_balance, 0))::DOUBLE AS strength FROM k2),
 k4 AS (SELECT *, round(CASE WHEN strength >= 35 THEN least(95, 60 + 0.35::DOUBLE * strength) END, 4) AS strength_confidence FROM k3),
 verdicts AS (SELECT *, round(0.55::DOUBLE * coalesce(window_confidence, 0) + 0.25::DOUBLE * recruitability + 0.15::DOUBLE * talent + least(5 * decline, 15), 4) AS assess_window,
  round(0.48::DOUBLE * coalesce(collapse_confidence, 0) + 0.28::DOUBLE * coalesce(window_confidence, 0) + CASE WHEN health < 45 THEN 18 WHEN health < 65 THEN 24.5::DOUBLE ELSE 0 END + least(7 * decline, 28) + least(9 * whales_out, 24) + least(10 * removed, 22), 4) AS assess_collapse,
  round(0.65::DOUBLE * coalesce(strength_confidence, 0) + least(12 * growth, 30) + least(10 * greatest(whale_balance, 0), 20), 4) AS assess_strength,
  round(least(100, 0.55::DOUBLE * recruitability + 0.25::DOUBLE * (100 - least(health, 100)) + 8 * whales_out + 10 * decline), 4) AS opportunity FROM k4)
"""
_F = _D + f""", facts AS (SELECT DISTINCT 'growth' AS source, CASE WHEN delta > 0 THEN 'Power gain' ELSE 'Power loss' END AS title, CASE WHEN abs(delta) < 0.15 THEN 'MEDIUM' WHEN abs(delta) < 0.25 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 'player' AS entity_type, identifier AS entity_id, board, to_date, round(delta, 4) AS delta, coalesce(new_alliance, 'none') AS tag,
 sha256(concat_ws('|', 'growth', CASE WHEN delta > 0 THEN 'Power gain' ELSE 'Power loss' END, 'player', identifier, board, to_date)) AS fact_id FROM d WHERE abs(delta) >= 0.08)
"""


def add(name, build, sql):
    B.add(name, build)
    B.sql[name] = sql


def flat(f: Frames):
    return rs.flat_differences(differences_at_once(f.t("candidate_snapshots")))


def judged(f: Frames):
    return rs.judge(rs.counters(flat(f)))


def facts(f: Frames):
    return rs.publish(rs.growth_facts(flat(f)))


BD = ["board", "to_date"]
add("snapshot_diff_join", lambda f: flat(f).groupBy("board", "difference_type").agg(F.count("*").alias("n")), _D + "SELECT board, difference_type, count(*) AS n FROM d GROUP BY ALL")
_NAMED = """, x AS (SELECT board, lower(trim(name)) AS key, row_number() OVER (PARTITION BY board, seq, lower(trim(name)) ORDER BY identifier) AS nth, seq, server, alliance, power, max(seq) OVER (PARTITION BY board) AS last FROM r WHERE name IS NOT NULL)
SELECT coalesce(n.board, o.board) AS board, coalesce(n.key, o.key) AS key, coalesce(n.nth, o.nth) AS nth,
 CASE WHEN o.key IS NULL THEN 'ADDED' WHEN n.key IS NULL THEN 'REMOVED' WHEN n.server IS DISTINCT FROM o.server OR n.alliance IS DISTINCT FROM o.alliance THEN 'MOVED' WHEN n.power IS DISTINCT FROM o.power THEN 'MODIFIED' END AS kind
FROM (SELECT * FROM x WHERE seq = last AND last > 1) n FULL JOIN (SELECT * FROM x WHERE seq = last - 1 AND last > 1) o ON n.board = o.board AND n.key = o.key AND n.nth = o.nth"""


def named_differences(f: Frames):
    """Greedy matching by equal names: with several of one name the n-th of each side meet."""
    from ladderlake.operators.snapshot_delta import canonical_values_with_seq, last_deliveries

    slim = f.t("candidate_snapshots").where("board is not null and taken_on is not null")
    kept = slim.join(last_deliveries(slim).select("board", "taken_on", "delivery_id", "seq"), ["board", "taken_on", "delivery_id"])
    rows = canonical_values_with_seq(kept).distinct().where("name is not null")
    last = rows.groupBy("board").agg(F.max("seq").alias("last")).where("last > 1")
    x = rows.join(last, "board").where("seq >= last - 1").withColumn("key", F.lower(F.trim("name")))
    x = x.withColumn("nth", F.row_number().over(W.partitionBy("board", "seq", "key").orderBy("identifier")))
    side = lambda new: x.where(F.col("seq") == (F.col("last") if new else F.col("last") - 1)).select("board", "key", "nth", F.struct("server", "alliance", "power").alias("new" if new else "old"))
    both = side(True).join(side(False), ["board", "key", "nth"], "full")
    kind = F.expr("CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' WHEN NOT (new.server <=> old.server AND new.alliance <=> old.alliance) THEN 'MOVED' WHEN NOT (new.power <=> old.power) THEN 'MODIFIED' END")
    return both.select("board", "key", "nth", kind.alias("kind"))


add("difference_detect", named_differences, dq._P7 + _NAMED)
_MATCH = "80 + CASE WHEN q <= 0.01 THEN 20 WHEN q <= 0.03 THEN 15 WHEN q <= 0.07 THEN 10 WHEN q <= 0.12 THEN 5 ELSE 0 END"
_LABEL = "CASE WHEN score >= 90 THEN 'MATCH' WHEN score >= 70 THEN 'POSSIBLE' ELSE 'NO_MATCH' END"
add("entity_match", lambda f: f.t("sheet_players").select("sheet_row_id", "server", F.lower(F.trim("player")).alias("key"), "thp").join(f.t("player_rankings").select("entry_id", "server", F.lower(F.trim("player_name")).alias("key"), "power"), ["server", "key"])
    .withColumn("q", F.when(F.col("thp") > 0, F.abs(F.col("power") - F.col("thp")) / F.col("thp"))).withColumn("score", F.expr(_MATCH)).withColumn("label", F.expr(_LABEL)).select("sheet_row_id", "entry_id", "score", "label"),
    f"SELECT sheet_row_id, entry_id, score, {_LABEL} AS label FROM (SELECT *, {_MATCH} AS score FROM (SELECT sheet_row_id, entry_id, CASE WHEN thp > 0 THEN abs(power - thp)::DOUBLE / thp END AS q FROM sheet_players s JOIN player_rankings p ON s.server = p.server AND lower(trim(s.player)) = lower(trim(p.player_name))))")
add("diff_filters", lambda f: flat(f).where("difference_type = 'Moved'").select(*BD, "identifier", "old_server", "new_server", "old_alliance", "new_alliance"), _D + "SELECT board, to_date, identifier, old_server, new_server, old_alliance, new_alliance FROM d WHERE difference_type = 'Moved'")
_WH = f"CASE difference_type WHEN 'Added' THEN 'INCOMING' WHEN 'Removed' THEN 'OUTGOING' ELSE 'MOVED' END"
_WP = f"coalesce(new_power, old_power) >= {rs.WHALE} AND difference_type <> 'Modified'"
add("whale_events", lambda f: flat(f).where(_WP).groupBy(*BD, F.expr(_WH).alias("event")).agg(F.count("*").alias("n")).withColumn("severity", F.expr(rs.WHALE_SEVERITY)),
    _D + f"SELECT *, CASE n WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM (SELECT board, to_date, {_WH} AS event, count(*) AS n FROM d WHERE {_WP} GROUP BY ALL)")
add("growth_facts", facts, _F + "SELECT * FROM facts")
add("publish_facts", lambda f: facts(f).groupBy("title").agg(F.count("*").alias("n"), F.countDistinct("fact_id").alias("ids")), _F + "SELECT title, count(*) AS n, count(DISTINCT fact_id) AS ids FROM facts GROUP BY 1")
_AL = "coalesce(old_alliance, new_alliance, 'none')"
add("alliance_facts", lambda f: flat(f).groupBy("board", F.expr(_AL).alias("alliance")).agg(*[F.count_if(F.col("difference_type") == k).alias(k.lower()) for k in ("Added", "Removed", "Moved", "Modified")], F.count_if(F.col("delta") <= -0.2).alias("critical"), F.count_if((F.col("delta") <= -0.12) & (F.col("delta") > -0.2)).alias("high")),
    _D + f"SELECT board, {_AL} AS alliance, count(*) FILTER (WHERE difference_type = 'Added') AS added, count(*) FILTER (WHERE difference_type = 'Removed') AS removed, count(*) FILTER (WHERE difference_type = 'Moved') AS moved, count(*) FILTER (WHERE difference_type = 'Modified') AS modified, count(*) FILTER (WHERE delta <= -0.2) AS critical, count(*) FILTER (WHERE delta <= -0.12 AND delta > -0.2) AS high FROM d GROUP BY ALL")
add("structural_health", lambda f: flat(f).groupBy("board", F.expr(_AL).alias("alliance")).agg(F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(F.expr(rs.DECLINE_POINTS)), F.lit(0))).cast("bigint").alias("health")),
    _D + f"SELECT board, {_AL} AS alliance, CAST(greatest(0, 100 - coalesce(sum({_POINTS}), 0)) AS BIGINT) AS health FROM d GROUP BY ALL")


def talent(f: Frames):
    """Talent of each alliance tag of a server by its strongest players."""
    h = f.hero.join(f.hero.groupBy("server").agg(F.max("ord").alias("ord")), ["server", "ord"])
    w = W.partitionBy("server").orderBy(F.desc("value"), "entity")
    p = h.withColumn("i", F.row_number().over(w))
    g = p.groupBy("server").agg(
        F.count("*").alias("players"), *[F.count_if(F.col("value") >= m * 1_000_000).alias(f"n{m}") for m in (180, 200, 250, 300)], F.sum("value").alias("total"),
        F.sum(F.when(F.col("i") == 1, F.col("value"))).alias("top1"), F.sum(F.when(F.col("i") <= 5, F.col("value"))).alias("top5"), F.median("value").alias("median_value"),
    )
    return g.select("server", "players", "n180", "n200", "n250", "n300", "median_value", F.round(F.col("top5") * 100.0 / F.col("total"), 4).alias("top5_share"), F.least(F.col("n180") + 2 * F.col("n200") + 4 * F.col("n250") + 8 * F.col("n300"), F.lit(100)).alias("talent_score"))


from ladderlake.plans.base import with_base  # noqa: E402

add("talent_metrics", talent, with_base(""", n AS (SELECT server, max(ord) AS ord FROM hero GROUP BY 1), p AS (SELECT hero.*, row_number() OVER (PARTITION BY hero.server ORDER BY value DESC, entity) AS i FROM hero JOIN n USING (server, ord))
SELECT server, count(*) AS players, count(*) FILTER (WHERE value >= 180000000) AS n180, count(*) FILTER (WHERE value >= 200000000) AS n200, count(*) FILTER (WHERE value >= 250000000) AS n250, count(*) FILTER (WHERE value >= 300000000) AS n300, median(value) AS median_value,
round(sum(value) FILTER (WHERE i <= 5) * 100.0::DOUBLE / sum(value), 4) AS top5_share, least(n180 + 2 * n200 + 4 * n250 + 8 * n300, 100) AS talent_score FROM p GROUP BY 1"""))


def judged_query(name: str, columns: list[str], where: str | None = None, extra: dict[str, str] | None = None) -> None:
    extra = extra or {}
    add(name, lambda f: (judged(f).where(where) if where else judged(f)).select(*BD, *columns, *[F.expr(e).alias(a) for a, e in extra.items()]),
        _K + f"SELECT board, to_date{''.join(', ' + c for c in columns)}{''.join(f', {e} AS {a}' for a, e in extra.items())} FROM verdicts" + (f" WHERE {where}" if where else ""))


judged_query("server_indicators", ["whale_balance", "transfer_activity", "alliance_stability", "strategic_risk"])
judged_query("indicator_levels", [], extra={"transfer_level": rs.LEVEL.format(x="transfer_activity"), "risk_level": rs.LEVEL.format(x="strategic_risk"), "talent_level": rs.LEVEL.format(x="talent")})
judged_query("reason_collapse", ["collapse", "collapse_confidence"], "collapse_confidence IS NOT NULL")
judged_query("reason_recruitment", ["window_score", "window_confidence"], "window_confidence IS NOT NULL")
judged_query("reason_strength", ["strength", "strength_confidence"], "strength_confidence IS NOT NULL")
judged_query("reason_select", [], extra={"selected": rs.SELECTED})
judged_query("assess_recruitment_window", ["assess_window"], "assess_window >= 45")
judged_query("assess_collapse", ["assess_collapse"], "assess_collapse >= 60", {"severity": rs.COLLAPSE_SEVERITY})
judged_query("assess_strength", ["assess_strength"], "assess_strength >= 45")
judged_query("opportunity", ["opportunity"], "opportunity >= 35", {"priority": rs.PRIORITY})
judged_query("recruitment_value", [], extra={"value": f"round({rs.VALUE}, 4)"})
judged_query("server_status", [], extra={"status": rs.STATUS})
judged_query("server_recommendation", [], extra={"recommendation": f"CASE {rs.STATUS} WHEN 'Critical' THEN 'Defend' WHEN 'Unstable' THEN 'Recruit' WHEN 'Active' THEN 'Observe' ELSE 'Hold' END"})
judged_query("app_assessment", [], extra={"confidence": "greatest(coalesce(collapse_confidence, 0), coalesce(window_confidence, 0), coalesce(strength_confidence, 0))"})
judged_query("advisor", ["opportunity"], "opportunity >= 65", {"sentence": "concat('Approach ', board, ' now')"})
judged_query("collapse_recommendation", [], "collapse >= 35", {"advice": "CASE WHEN health < 30 THEN 'Contact leaders' ELSE 'Watch departures' END"})
add("assess_engine", lambda f: judged(f).select(*BD, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("score")) for k, c in (("WINDOW", "assess_window"), ("COLLAPSE", "assess_collapse"), ("STRENGTH", "assess_strength"))])).alias("a")).select(*BD, "a.*")
    .withColumn("n", F.row_number().over(W.partitionBy(*BD).orderBy(F.desc("score"), "kind"))).where("n = 1 and score >= 45").drop("n"),
    _K + "SELECT board, to_date, kind, score FROM (SELECT board, to_date, 'WINDOW' AS kind, assess_window AS score FROM verdicts UNION ALL SELECT board, to_date, 'COLLAPSE', assess_collapse FROM verdicts UNION ALL SELECT board, to_date, 'STRENGTH', assess_strength FROM verdicts) QUALIFY row_number() OVER (PARTITION BY board, to_date ORDER BY score DESC, kind) = 1 AND score >= 45")
FC = ["fact_id", "board", "to_date", "entity_id", "severity"]
add("facts_by_source", lambda f: facts(f).where("lower(source) = 'growth'").select(*FC), _F + "SELECT fact_id, board, to_date, entity_id, severity FROM facts WHERE lower(source) = 'growth'")
add("facts_by_tag", lambda f: facts(f).where("lower(tag) like 'a%'").select(*FC, "tag"), _F + "SELECT fact_id, board, to_date, entity_id, severity, tag FROM facts WHERE lower(tag) LIKE 'a%'")
add("facts_by_severity", lambda f: facts(f).where("severity = 'CRITICAL'").select(*FC), _F + "SELECT fact_id, board, to_date, entity_id, severity FROM facts WHERE severity = 'CRITICAL'")
for _name, _col in (("fact_counts_by_source", "source"), ("fact_counts_by_tag", "tag"), ("fact_counts_by_entity", "entity_id")):
    add(_name, lambda f, c=_col: facts(f).groupBy(c).agg(F.count("*").alias("n")), _F + f"SELECT {_col}, count(*) AS n FROM facts GROUP BY 1")
add("breaking_news", lambda f: facts(f).withColumn("weight", F.expr(rs.SEVERITY_RANK)).orderBy(F.desc("weight"), F.desc("to_date"), "fact_id").limit(20).select("fact_id", "weight"), _F + f"SELECT fact_id, {rs.SEVERITY_RANK} AS weight FROM facts ORDER BY weight DESC, to_date DESC, fact_id LIMIT 20")
add("latest_facts", lambda f: facts(f).orderBy(F.desc("to_date"), "fact_id").limit(25).select("fact_id", "to_date"), _F + "SELECT fact_id, to_date FROM facts ORDER BY to_date DESC, fact_id LIMIT 25")
add("fact_adapter", lambda f: facts(f).withColumn("weight", F.expr(rs.SEVERITY_RANK)).groupBy("board").agg(F.max("weight").alias("weight"), F.count("*").alias("facts")), _F + f"SELECT board, max({rs.SEVERITY_RANK}) AS weight, count(*) AS facts FROM facts GROUP BY 1")


def watchlist(f: Frames):
    t = f.t("recruitment_targets").select("server", "name", "alliance", "priority", "score", "board_date", "target_row_id").where("name is not null")
    t = t.withColumn("key", F.lower(F.trim("name"))).withColumn("weight", F.expr("CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END"))
    best = F.max(F.struct("weight", "score", (-F.col("target_row_id")).alias("m"), "priority"))
    return t.groupBy("server", "key").agg(best.alias("b")).select("server", "key", F.col("b.weight").alias("weight"), F.col("b.score").alias("score"), F.col("b.priority").alias("priority"))


_WATCH = ", w AS (SELECT server, lower(trim(name)) AS key, CASE priority WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS weight, score, priority FROM recruitment_targets WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY server, key ORDER BY weight DESC, score DESC NULLS LAST, target_row_id) = 1)\n"
add("watchlist_build", watchlist, with_base(_WATCH + "SELECT * FROM w"))
add("watch_top", lambda f: watchlist(f).orderBy(F.desc("weight"), F.desc_nulls_last("score"), "server", "key").limit(10), with_base(_WATCH + "SELECT * FROM w ORDER BY weight DESC, score DESC NULLS LAST, server, key LIMIT 10"))
add("watch_by_priority", lambda f: watchlist(f).groupBy("priority").agg(F.count("*").alias("n")), with_base(_WATCH + "SELECT priority, count(*) AS n FROM w GROUP BY 1"))
add("watch_by_server", lambda f: watchlist(f).where("server = 551"), with_base(_WATCH + "SELECT * FROM w WHERE server = 551"))
add("advisor_rank", lambda f: watchlist(f).withColumn("place", F.row_number().over(W.partitionBy("server").orderBy(F.desc_nulls_last("score"), F.desc("weight"), "key"))).where("place <= 5"),
    with_base(_WATCH + "SELECT *, row_number() OVER (PARTITION BY server ORDER BY score DESC NULLS LAST, weight DESC, key) AS place FROM w QUALIFY place <= 5"))
_LIFE = "SELECT DISTINCT server, name, priority, board_date, received_at, target_row_id FROM recruitment_targets WHERE name IS NOT NULL"
add("watch_lifecycle", lambda f: f.t("recruitment_targets").select("server", "name", "priority", "board_date", "received_at", "target_row_id").where("name is not null").distinct()
    .withColumn("before", F.lag("priority").over(W.partitionBy("server", "name").orderBy("board_date", "received_at", "target_row_id"))).where("not (before <=> priority)").select("server", "name", "board_date", "target_row_id", "priority"),
    f"SELECT server, name, board_date, target_row_id, priority FROM (SELECT *, lag(priority) OVER (PARTITION BY server, name ORDER BY board_date, received_at, target_row_id) AS before FROM ({_LIFE})) WHERE before IS DISTINCT FROM priority")
add("morning_report", lambda f: judged(f).groupBy("to_date").agg(F.sum("added").alias("a"), F.sum("removed").alias("r"), F.sum("moved").alias("m")).select("to_date", F.format_string("%s: %d added, %d removed, %d moved", "to_date", "a", "r", "m").alias("line")),
    _K + "SELECT to_date, format('{}: {} added, {} removed, {} moved', to_date, sum(added), sum(removed), sum(moved)) AS line FROM verdicts GROUP BY to_date")

QUERIES, SQL = B.queries, B.sql
