"""Named queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderlake.llm import leakage, lookalike, matching, mixing, personal, survivors
from ladderlake.session import table


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched rows of both tables with their confidence."""
    left = matching.records(table(spark, sf_dir, "sheet_players"), "sheet_row_id", "server", "player", "alliance", "thp")
    right = matching.records(table(spark, sf_dir, "player_rankings"), "entry_id", "server", "player_name", "alliance_tag", "power")
    return matching.match(left, right).select(F.col("left_id").alias("sheet_row_id"), F.col("right_id").alias("entry_id"), "confidence", "alike", "agrees")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("sheet_row_id", "entry_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "entities").select("id", F.col("entity_type").alias("kind"), "name")
    r = table(spark, sf_dir, "ranking_rows").select("row_id", *_named_entity())
    bigrams = lookalike.train_bigrams(e, "name")
    return lookalike.lookalike_pairs(e, r, bigrams)


def _named_entity() -> list:
    hero = F.col("ranking_type") == "total_hero_power"
    ally = F.col("ranking_type") == "alliance_power"
    return [
        F.when(hero, "player").when(ally, "alliance").alias("kind"),
        F.when(hero, F.col("player_name")).when(ally, F.col("name")).alias("name"),
    ]


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical form of every entity name that has another one."""
    e = table(spark, sf_dir, "entities").select("id", "entity_type", "name")
    form = lookalike.canonical_column(F.col("name"), lookalike.train_bigrams(e, "name"))
    return e.withColumn("canonical_name", form).where("canonical_name <> name").distinct()


GROUP = ["server", "captured_on", "slot"]


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {
        "name": survivors.text_value(F.col("name")),
        "power": survivors.positive_value(F.col("power")),
        "raw_player_name": survivors.text_value(F.col("raw_player_name")),
    }
    f = survivors.survivors(table(spark, sf_dir, "fragments"), GROUP, fields, "fragment_id", "confidence", "seen_at")
    return f.withColumn("captured_on", F.date_format("captured_on", "yyyy-MM-dd"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survivors(spark, sf_dir).select(*GROUP, "name_from", "power_from", "raw_player_name_from")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record itself, each field from the row that knows it best."""
    return _survivors(spark, sf_dir).select(*GROUP, "name", F.col("power").cast("bigint").alias("power"), "raw_player_name")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "heldout_items"), table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(mixing.token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.reached_shares(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_places(table(spark, sf_dir, "documents"))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.redacted_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found, "p1_matches": p1_matches,
    "p2_found": p2_found, "p2_forms": p2_forms, "p6_found": p6_found, "p6_records": p6_records,
    "p8_found": p8_found, "p8_report": p8_report, "p9_mix": p9_mix, "p9_shares": p9_shares,
    "p10_found": p10_found, "p10_redacted": p10_redacted,
}

_P6 = """
WITH d AS (SELECT DISTINCT fragment_id, server, captured_on, slot, name, raw_player_name, power, confidence, seen_at FROM fragments),
  v AS (SELECT fragment_id, server, captured_on, slot, confidence, seen_at,
     CASE WHEN regexp_matches(name, '[\\p{L}\\p{N}]') AND lower(trim(name)) NOT IN ('n/a', 'null') THEN name END AS name,
     CASE WHEN regexp_matches(raw_player_name, '[\\p{L}\\p{N}]') AND lower(trim(raw_player_name)) NOT IN ('n/a', 'null') THEN raw_player_name END AS raw_player_name,
     CASE WHEN power > 0 THEN power END AS power FROM d)
SELECT server, strftime(captured_on, '%Y-%m-%d') AS captured_on, slot, COLUMNS FROM v
GROUP BY server, v.captured_on, slot HAVING count(DISTINCT fragment_id) > 1
"""
_BEST = "(list(struct_pack(v := VALUE, i := fragment_id) ORDER BY confidence DESC NULLS LAST, seen_at DESC NULLS LAST, fragment_id) FILTER (WHERE FIELD IS NOT NULL))[1]"


def _best(field: str, value: bool) -> str:
    picked = _BEST.replace("VALUE", field).replace("FIELD", field)
    return f"{picked}.v AS {field}" if value else f"{picked}.i AS {field}_from"


SQL: dict[str, str] = {
    "p6_found": _P6.replace("COLUMNS", ", ".join(_best(f, False) for f in ("name", "power", "raw_player_name"))),
    "p6_records": _P6.replace("COLUMNS", ", ".join(_best(f, True) for f in ("name", "power", "raw_player_name"))),
}
