"""Rows, guards, validation, text functions, sources and streams on small fixtures."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ladderlake.functions import text as tx
from ladderlake.operators import guards, rows, validate, warehouse
from ladderlake.sources import readers, writers
from ladderlake.streaming import pipelines

AT = dt.datetime(2025, 5, 1)
GUARD = "row_id bigint, snapshot_id bigint, server int, ranking_type string, lane string, source_file string, rank int, name string, alliance_tag string, player_name string, power bigint, server_confidence double, captured_at timestamp"


def guard_rows(powers, server=552, kind="alliance_power", tags=None, confidence=1.0, first=1):
    return [(first + i, server, server, kind, "operational", "f.png", r, f"n{i}", (tags or ["T"] * len(powers))[i], None, p, confidence, AT) for i, (r, p) in enumerate(powers)]


def test_outlier_is_quarantined_and_a_low_tail_is_not(spark):
    powers = [(1, 27991893823), (2, 23873369613), (3, 23575109261), (4, 22992042788), (5, 20477544820), (7, 79085297891), (6, 19376397986), (8, 12747228849)]
    got = {r["rank"]: r["decision"] for r in guards.power_sanity(spark.createDataFrame(guard_rows(powers), GUARD)).collect()}
    assert got[7] == "quarantine_high" and all(v == "pass" for k, v in got.items() if k not in (7, 8))
    tail = [(26 + i, p) for i, p in enumerate([896061016, 880224595, 827574513, 821848668, 747337757, 726980250, 673643806])]
    assert {r["decision"] for r in guards.power_sanity(spark.createDataFrame(guard_rows(tail), GUARD)).collect()} == {"pass"}


def test_blocks_inside_another_server_are_found(spark):
    big = guard_rows([(i, 300_000_000 - i * 1_000_000) for i in range(1, 101)], 551, "total_hero_power", ["IVE" if i % 2 else "PWW" for i in range(1, 101)])
    small = guard_rows([(1, 248_000_000), (2, 242_000_000), (3, 201_000_000)], 552, "total_hero_power", ["IVE", "PWW", "IVE"], 0.6, 1000)
    got = guards.content_blocks(spark.createDataFrame(big + small, GUARD), least=0.70).collect()
    assert [(r["server"], r["target"]) for r in got] == [(552, 551)]
    other = guard_rows([(1, 190_000_000), (2, 180_000_000), (3, 170_000_000)], 552, "total_hero_power", ["WARF", "LSC", "WARF"], 0.6, 1000)
    assert guards.content_blocks(spark.createDataFrame(big[:60] + other, GUARD), least=0.70).count() == 0


def test_guard_keeps_a_placeholder_for_each_quarantined_row(spark):
    df = spark.createDataFrame(guard_rows([(1, 5)], kind="total_hero_power"), GUARD)
    got = {(r["out_lane"], r["out_power"]) for r in guards.ranking_guard(df).collect()}
    assert got == {("operational", None), ("ranking_guard_quarantine", 5)}


@pytest.mark.parametrize(
    ("a", "b", "kind"), [(416693161, 416693161, "exact"), (239561010, 23956100, "scale_x10_truncated_digit"), (250009089, 25009089, "insert_zero"), (5, 900, "mismatch"), (None, 5, "missing")]
)
def test_power_comparison(spark, a, b, kind):
    df = spark.createDataFrame([(a, b)], "a bigint, b bigint")
    assert df.select(tx.compare_power(F.col("a"), F.col("b"))).first()[0] == kind


def test_texts(spark):
    df = spark.createDataFrame([("1.5b",), ("1,234",), ("2 m",), ("x",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tx.parse_magnitude(F.col("t"))).collect()] == [15_000_000_000, 1234, 2_000_000, None, None, None]
    assert tx.similarity("tarori", "tar0ri") > 0.8 and tx.similarity("", "") == 1.0 and tx.similarity("a", None) == 0.0
    assert [op for op, _, _ in tx.aligned("ab", "ac")] == ["MATCH", "SUBSTITUTE"] and tx.aligned("a", "a") == [("MATCH", "a", "a")]
    assert tx.kept_digits("123456", "1234560") > tx.kept_digits("123456", "923450")
    names = spark.createDataFrame([("MEITTü メ 메잇",), ("Lora",), ("꿈",), ("★",), (None,)], "n string")
    assert [r[0] for r in names.select(tx.name_category(F.col("n"))).collect()] == ["mixed_latin_cjk", "latin_only", "hangul_only", "symbols", "symbols"]


def token(i, text, x, y, c=0.9):
    return (1, "f.png", i, text, [[x, y - 8.0], [x + 60.0, y - 8.0], [x + 60.0, y + 8.0], [x, y + 8.0]], c)


def test_tokens_become_rows(spark):
    raw = [
        token(1, "1", 30.0, 100.0), token(2, "[PbC] Lora", 120.0, 101.0), token(3, "416,693,161", 500.0, 99.0), token(4, "[PbC] Lora", 121.0, 101.0, 0.2),
        token(5, "2", 30.0, 160.0), token(6, "Mena", 120.0, 161.0), token(7, "320306014", 500.0, 159.0),
    ]
    tokens = rows.token_dedup(rows.token_geometry(spark.createDataFrame(raw, "snapshot_id bigint, source_file string, token_id bigint, text string, box array<array<double>>, confidence double")))
    assert tokens.count() == 6
    for lines in (rows.y_islands(tokens), rows.y_clusters(tokens)):
        got = rows.parse_rows(rows.row_bands(lines, rows.row_anchors(lines))).collect()
        assert sorted((r["ocr_rank"], r["tag"], r["name"], r["power"]) for r in got) == [(1, "PbC", "Lora", 416693161), (2, None, "Mena", 320306014)]


def test_gaps_with_their_anchors(spark):
    found = spark.createDataFrame([(1, "thp", r) for r in (*range(1, 21), 23)], "snapshot_id bigint, ranking_type string, rank int")
    got = warehouse.gap_islands(found, 23).collect()
    assert [(r["gap_start"], r["gap_end"], r["gap_rows"], r["previous_anchor"], r["next_anchor"], r["bounded"]) for r in got] == [(21, 22, 2, 20, 23, True)]
    assert warehouse.gap_islands(found.limit(0), 10).count() == 0


ENTRY = "id bigint, server int, name string, tag string, power bigint, place int"


def test_two_of_two_truth_rows_score_full(spark):
    t = spark.createDataFrame([(1, 551, "Joncollins21", "PbC", 416693161, 1), (2, 551, "MEITTü メ 메잇", "IVE", 320306014, 2)], ENTRY)
    d = validate.detail(t.withColumnRenamed("id", "truth_id"), t.withColumnRenamed("id", "seen_id"))
    m = validate.metrics(d, []).first()
    assert (m["matched"], m["good"], m["score"], m["f1"]) == (2, 2, 100.0, 1.0)
    assert {r["triage"] for r in d.collect()} == {"clean"}


def test_greedy_pairs_equal_a_sequential_pass(spark):
    import random

    rng = random.Random(4)
    pairs = [(a, b, float(rng.randrange(20))) for a in range(15) for b in range(15) if rng.random() < 0.4]
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    df = spark.createDataFrame(pairs, "a bigint, b bigint, s double")
    assert {(r["a"], r["b"]) for r in validate.greedy_pairs(df, "a", "b", "s").collect()} == want


def test_sheets(spark):
    sheet = spark.createDataFrame([("1", "554", "KOLT", "20.527.387.472", None), ("2", "554", None, "11m", "TOS")], "`#` string, Server string, Alliance string, Strength string, Tag string")
    got = readers.canonical_sheet(sheet).collect()
    assert [(r["server"], r["alliance"], r["value"]) for r in got] == [(554, "KOLT", 20527387472), (554, "TOS", 11_000_000)]
    with pytest.raises(ValueError, match="server"):
        readers.canonical_sheet(sheet.drop("Server"))
    wide = spark.createDataFrame([(1, 5, None), (2, None, 7)], "server int, kills bigint, cities bigint")
    assert {tuple(r) for r in readers.wide_metrics(wide, ["server"]).collect()} == {(1, "kills", 5), (2, "cities", 7)}
    cells = spark.createDataFrame([("s", 0, "Server 551", None), ("s", 1, "PbC", "x"), ("s", 2, "server 552", None), ("s", 3, "IVE", "y")], "sheet string, row int, c0 string, c1 string")
    assert [(r["c0"], r["server"]) for r in readers.section_rows(cells).orderBy("row").collect()] == [("PbC", 551), ("IVE", 552)]
    flat = spark.createDataFrame([("s", 0, 0, "554"), ("s", 0, 1, "2,000,000"), ("s", 0, 2, "5"), ("s", 1, 0, "554"), ("s", 1, 2, "9000000")], "sheet string, row int, col int, text string")
    assert [(r["server"], r["value"]) for r in readers.adjacent_pairs(flat).collect()] == [(554, 2000000)]


def test_token_documents(spark, tmp_path):
    doc = {"schema": "cache.v1", "mode": "rows", "source_file": "a.png", "results": [[[[1, 2], [3, 2], [3, 4], [1, 4]], "192,174,644", 0.987]]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    r = readers.token_documents(spark, str(tmp_path)).first()
    assert (r["text"], r["confidence"], r["box"][2]) == ("192,174,644", 0.987, [3.0, 4.0])


def test_upserts_and_revisions(spark, tmp_path):
    schema = "k int, at int, v string"
    first, second = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema), spark.createDataFrame([(1, 2, "c"), (1, 0, "old")], schema)
    writers.upsert_table(spark, str(tmp_path / "t"), first, ["k"], "at", 0)
    path = writers.upsert_table(spark, str(tmp_path / "t"), second, ["k"], "at", 1)
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 2, "c"), (2, 1, "b")}
    assert writers.save_revision(first, str(tmp_path / "r"), "revision", 0) == 1
    assert writers.save_revision(first, str(tmp_path / "r"), "skip", 1) == 1


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id bigint, ts timestamp, kind string, value bigint"
    rows = [(i % 40, AT + dt.timedelta(minutes=i), "ab"[i % 2], i) for i in range(60)]
    source = str(tmp_path / "in")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    batch = spark.read.schema(schema).parquet(source)
    stream = pipelines.memory(pipelines.stream_table(spark, source, schema), "kind", "ts")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("seen").collect()} == {tuple(r) for r in pipelines.memory(batch, "kind", "ts").collect()}
    sink = str(tmp_path / "out")
    query = pipelines.stream_table(spark, source, schema).writeStream.foreachBatch(pipelines.upsert_writer(sink, ["event_id"], "value")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r["value"] for r in spark.read.parquet(f"{sink}/g1").collect()} == {max(v for i, _, _, v in rows if i == e) for e in range(40)}


SIDE = "server int, name string, tag string, power bigint, place int"


def test_evidence_finds_rounded_and_repaired_powers_with_a_margin(spark):
    truth = spark.createDataFrame(
        [
            (1, 551, "Lora", "PbC", 416693161, 1), (2, 551, "Mena", "PbC", 320306014, 2), (3, 551, "Tarori", None, 239561010, 3), (4, 551, "Kobu", "IVE", 250009089, 4),
            (5, 551, "Twin", "PWW", 200000000, 5), (6, 551, "Alone", "AAA", 190000000, 6), (7, 551, "Shared", "PWW", 180000000, 7),
        ],
        "truth_id bigint, " + SIDE,
    )
    seen = spark.createDataFrame(
        [
            (11, 551, "?", None, 416693161, 1), (12, 551, "Mena", "PbC", 320310000, 2), (13, 551, "Tar0ri", None, 23956101, 3), (14, 551, "Kobu", "IVE", 25009089, 4),
            (15, 551, "Twin", "PWW", 200001000, 5), (16, 551, "Twin", "PWW", 200001001, 6), (17, 551, "Other", "BBB", 190001000, 7), (18, 551, "Shared", "PWW", 180001000, 8),
            (19, 551, "Shared", "PWW", 180000000, 9), (20, 551, "Shared", "PWW", 180000000, 10), (21, 552, "Mena", "PbC", 320306014, 2),
        ],
        "seen_id bigint, " + SIDE,
    )
    got = {r["truth_id"]: (r["seen_id"], r["kind"]) for r in validate.evidence_candidates(truth, seen).collect()}
    assert got == {1: (11, "exact"), 2: (12, "near"), 3: (13, "scale_x10_truncated_digit"), 4: (14, "insert_zero"), 7: (18, "near")}


def test_tags_are_normalized_by_tiers_and_unmatched_ones_stay(spark):
    known = spark.createDataFrame([(1, k) for k in ("PbC", "WXYZQ", "abcdefgh")] + [(2, "IVE"), (2, "IVA")], "server int, known string")
    tags = spark.createDataFrame([(1, t) for t in ("pbc", "PC", "WYQ", "abcdxygh", "abcdexfygh", "kkk")] + [(2, "IV"), (2, "IVE"), (3, "PbC"), (None, "PbC"), (1, None)], "server int, tag string")
    got = {(r["server"], r["tag"]): (r["known"], r["state"]) for r in validate.normalize_tags(tags, known).collect()}
    assert got == {
        (1, "pbc"): ("PbC", "exact"), (1, "PC"): ("PbC", "edit"), (1, "WYQ"): ("WXYZQ", "subsequence"), (1, "abcdxygh"): (None, "unmatched"), (1, "abcdexfygh"): ("abcdefgh", "ratio"),
        (1, "kkk"): (None, "unmatched"), (2, "IV"): (None, "ambiguous"), (2, "IVE"): ("IVE", "exact"), (3, "PbC"): (None, "unmatched"), (None, "PbC"): (None, "unmatched"),
    }


def test_columns_of_a_row(spark):
    rows_ = [["0咀#5", "[PbC] Lora", "Mena"], ["IPbC] Lora"], ["★", "꿈"], ["PbC]", "Lo  ra"], ["[12] Lora"], [], None]
    df = spark.createDataFrame([(w,) for w in rows_], "w array<string>")
    got = [tuple(r[0]) for r in df.select(rows.reconstruct_columns(F.col("w"))).collect()]
    assert got[:6] == [("PbC", "Lora Mena", True), ("PbC", "Lora", False), (None, "꿈", True), ("PbC", "Lo ra", False), (None, "[12] Lora", False), (None, "", False)]


@pytest.mark.parametrize("hot_rows", [1000, 5])
def test_places_in_groups_of_any_size(spark, hot_rows):
    from ladderlake.operators.ranks import place_within

    data = [(i, None if i % 7 == 0 else i % 3, (i * 37) % 50) for i in range(200)]
    got = place_within(spark.createDataFrame(data, "id int, g int, v int"), "g", [F.desc("v"), F.col("id")], hot_rows=hot_rows)
    want = {}
    for i, g, v in sorted(data, key=lambda r: (-r[2], r[0])):
        want.setdefault(g, []).append(i)
    assert {r["id"]: r["place"] for r in got.collect()} == {i: n for ids in want.values() for n, i in enumerate(ids, 1)}
