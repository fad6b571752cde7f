"""Cleaning functions on readings of one's own."""

import itertools
import random

from pyspark.sql import functions as F

from ladderlake.functions import cleaning as cl


def one(spark, make, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def test_servers_come_in_the_order_of_the_forms(spark):
    assert one(spark, cl.server_candidates, "Kriegszone #612 and Warzone 613", "Wagzone {8614", "zona de guerra 77", "rank 12", "", None) == [[612, 613, 613, 612, 612, 613], [614, 614, 614], [], [], [], None]


def test_lines_that_are_no_names(spark):
    assert one(spark, cl.is_warzone, "Warzone #551", "Wagzom. 612", "my zone", None) == [True, True, False, None]
    assert one(spark, cl.clean_name_part, " Lora ", "Total Hero Power", "Warzone 551", "12", "416,693,l6I", "", None) == ["Lora", "", "", "", "", "", None]
    assert one(spark, cl.clean_power, "x 416,693,l6I y", "1 234 56", "no", None) == [416693161, None, None, None]


def test_normal_forms_cost_confidence(spark):
    flat = lambda make, *v: [(r["value"], r["confidence"], r["corrected"]) for r in one(spark, make, *v)]
    assert flat(cl.normalize_tag, "ABc", "({ABc]", " ", None) == [("ABc", 1.0, False), ("ABc", 0.95, True), ("", 1.0, False), ("", 1.0, False)]
    assert flat(cl.normalize_name, "Lora", "[Ｌ0ra|", "Berl", None) == [("Lora", 1.0, False), ("Lora", 0.92, True), ("Beri", 0.96, True), ("UNKNOWN", 1.0, False)]
    assert flat(cl.normalize_power, "12,345", "l2,34O", "", None) == [("12345", 1.0, False), ("12340", 0.94, True), ("", 1.0, False), ("", 1.0, False)]


def test_identities(spark):
    df = spark.createDataFrame([("xx [ABc] Lora 123456789", 0.5), ("Lora", 0.9), ("Lora", 0.1), ("[ABc] ---", 1.0), ("Warzone", 1.0), (None, None)], "t string, c double")
    got = [tuple(r[0]) for r in df.select(cl.parse_identity(F.col("t"), F.col("c"))).collect()]
    assert got == [("ABc", "Lora", 0.8, "VALID"), (None, "Lora", 0.85, "VALID"), (None, "Lora", 0.65, "VALID"), ("ABc", "UNKNOWN", 0.25, "REVIEW"), (None, "UNKNOWN", 0.25, "REVIEW"), (None, "UNKNOWN", 0.25, "REVIEW")]


def cheapest(a, b):
    if not a or not b:
        return len(a) + len(b)
    return min(cheapest(a[1:], b[1:]) + (a[0] != b[0]), cheapest(a[1:], b) + 1, cheapest(a, b[1:]) + 1)


def test_edit_steps_are_cheapest_and_rebuild_the_reading():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab0O") for _ in range(rng.randrange(0, 6))) for _ in range(14)]
    for a, b in itertools.product(words, words):
        steps = cl.edit_steps(a, b)
        assert sum(op != "equal" for op, *_ in steps) == cheapest(a, b)
        assert "".join(e for _, _, e, _ in steps) == a and "".join(o for _, _, _, o in steps) == b


def test_character_differences(spark):
    df = spark.createDataFrame([("L0ra", "Lora"), ("Lora", "Lora"), ("ab", "axb"), (None, "c"), (None, None)], "a string, b string")
    got = [[(d["op"], d["place"], d["reason"]) for d in r[0]] for r in df.select(cl.character_differences("a", "b")).collect()]
    assert got == [[("replace", 1, "same_confusion_family_difference")], [], [("insert", 1, "display_character_difference")], [("insert", 0, "ocr_confusable_character_difference")], []]
