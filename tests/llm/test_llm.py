"""Training-data operators against brute force and on awkward inputs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderlake.llm import leakage, lookalike, matching, mixing, personal, queries, survivors
from ladderlake.llm.textforms import plain_words

T0 = dt.datetime(2025, 1, 1)

# --- matching ----------------------------------------------------------------
PLAYER = "id bigint, server bigint, name string, tag string, power bigint, tokens string"


def players(spark, rows):
    return matching.records(spark.createDataFrame([(*r, "clash") for r in rows], PLAYER), "id", "server", "name", "tag", "power")


def bags(rows, words, idf):
    n = np.array([len(t) for _, t in rows])
    flat = np.array([words[x] for _, t in rows for x in t])
    sat = (matching.K1 + 1) / (1 + matching.K1 * (1 - matching.B + matching.B * n / n.mean()))
    return matching.Bags(np.array([i for i, _ in rows]), flat, np.cumsum(n) - n, n, idf, sat)


@pytest.mark.parametrize("batch", [50, 4_000_000])
def test_pruned_search_is_exact(monkeypatch, batch):
    monkeypatch.setattr(matching, "BATCH_POSTINGS", batch)
    rng = random.Random(2)
    pool = [int(rng.paretovariate(0.7)) % 60 for _ in range(4000)]
    make = lambda base, n: [(base + i, sorted(set(rng.sample(pool, rng.randrange(3, 9))))) for i in range(n)]
    index, asked = make(0, 120), make(1000, 60)
    df = {x: sum(x in t for _, t in index) for x in range(60)}
    idf = np.array([math.log(1 + (120 - df[x] + 0.5) / (df[x] + 0.5)) for x in range(60)])
    words = {x: x for x in range(60)}
    a, b = bags(asked, words, idf), bags(index, words, idf)
    q, d = matching.top_k(a, b, 3)
    scores = matching.pair_scores(a, b, q, d)
    got = {}
    for x, s in zip(q, scores, strict=True):
        got.setdefault(int(x), []).append(float(s))
    for i, (_, tokens) in enumerate(asked):
        every = sorted((sum(idf[x] for x in set(t) & set(tokens)) * b.saturation[j] for j, (_, t) in enumerate(index) if set(t) & set(tokens)), reverse=True)[:3]
        assert sorted(got.get(i, []), reverse=True) == pytest.approx(every, abs=1e-5)


def test_players_match_through_misreadings(spark):
    left = players(spark, [
        (1, 551, "Tarori", "ACEv", 292341388), (2, 551, "Vupadase", "MEM", 443080400), (3, 551, "VupadaseII", "MEM", 309861960), (4, 551, "Nobody", "ZZZ", 111111111), (5, 551, None, None, None),
        (6, 551, "Tarori", "ACEv", 292341388), (7, None, "Lurnehipu", "z37M", 511847443), (8, 552, "Tarori", "ACEv", 292341388),
    ])
    right = players(spark, [
        (11, 551, "[ACEv] Tar0ri", None, 292355121), (12, 551, "Vupadaose", "MEM", 443080400), (13, 551, "VupadaseII", "MEM", 309861960), (14, 551, "", None, 5), (15, 553, "Lumehipu", "z37M", 511847443),
    ])
    got = {(r["left_id"], r["right_id"]) for r in matching.match(left, right).collect()}
    assert got == {(1, 11), (6, 11), (2, 12), (3, 13), (7, 15)}
    assert all(0 <= r["confidence"] <= 1 for r in matching.match(left, right).collect())


@pytest.mark.parametrize("step", [0, 1_000_000], ids=["copies", "rivals"])
def test_partners_behind_many_others_are_found(spark, step):
    others = [(10 + i, 551, f"Tarori{'aa' if not step else chr(97 + i) * 2}", "ACEv", 150_000_000 + i * step) for i in range(6)]
    left = players(spark, [(1, 551, "Tarori", "ACEv", 292341388), *[(100 + i, *o[1:]) for i, o in enumerate(others)]])
    right = players(spark, [*others, (31, 551, "Taro", None, 292341388)])
    got = {(r["left_id"], r["right_id"]) for r in matching.match(left, right, near=2).collect()}
    assert (1, 31) in got and {x for x in got if x[0] > 1} == {(100 + i, 10 + (i if step else 0)) for i in range(6)}


def test_blocks_and_shards_find_the_same(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("bdfgkmnprstvz") + rng.choice("aeiou") for _ in range(5))
    people = [(i, rng.choice([551, 551, 552, None]), name().title(), rng.choice(["AA", "BB", None]), rng.randrange(10**8, 9 * 10**8)) for i in range(120)]
    typo = lambda n: n[:3] + n[4:] if rng.random() < 0.3 else n
    left = players(spark, people)
    right = players(spark, [(1000 + i, rng.choice([s or 553, s or 553, None]), typo(n), g, p if rng.random() < 0.6 else round(p, -6)) for i, s, n, g, p in people])
    whole = {tuple(r) for r in matching.match(left, right).collect()}
    assert whole == {tuple(r) for r in matching.match(left, right, block=16).collect()}
    assert len(whole) >= 115 and all(b == a + 1000 for a, b, *_ in whole)


def test_confidence_is_calibrated_on_names_it_was_not_set_by(spark):
    """Right pairs with other names than the tables have: most come out, and few of the persons that stand on one side only."""
    rng = random.Random(9)
    word = lambda: rng.choice(["Storm", "Iron", "Lady", "Black", "Wolf", "Old", "River", "Kaiser", "Night", "Frost"]) + rng.choice(["rider", "fang", "smith", "born", "queen", "hunter", "walker"])
    people = [(i, 700 + i % 20, f"{word()}{rng.choice(['', ' of ' + word(), str(rng.randrange(99))])}", f"T{rng.randrange(9)}", rng.randrange(10**8, 6 * 10**8)) for i in range(800)]

    def read(n):
        k = rng.randrange(len(n))
        return rng.choice([n, n.upper(), n[:k] + n[k + 1 :], n[:k] + rng.choice("aeirst") + n[k:]])

    left = players(spark, people[:700])
    right = players(spark, [(10_000 + i, s, read(n), rng.choice([t, t, None, "T0"]), int(p * rng.uniform(0.98, 1.02)) if rng.random() < 0.3 else p) for i, s, n, t, p in people[100:]])
    got = {(r["left_id"], r["right_id"]) for r in matching.match(left, right).collect()}
    true = {(i, 10_000 + i) for i in range(100, 700)}
    assert len(got & true) >= 0.98 * len(true) and len(got & true) >= 0.98 * len(got)


def test_matching_with_an_empty_side(spark):
    some, none = players(spark, [(1, 551, "Tarori", "ACEv", 292341388)]), players(spark, [])
    assert matching.match(some, none).count() == 0 and matching.match(none, some).count() == 0


# --- look-alikes -------------------------------------------------------------
@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Zogobona", "Zоɡobona", True), ("Gamidesu", "Ｇａｍｉｄｅｓｕ", True), ("Waϲhe", "Wache", True), ("Setá", "Setá", True), ("Se​ta ", "Seta", True), ("A b", "A b", True),
        ("Рикачо", "Pикачо", True), ("é", "е́", True), ("ガキ", "ｶﾞｷ", True), ("Seta", "seta", False), ("Seta", "Setá", False), ("0l", "Ol", False), ("A  b", "A b", False), ("", "​", True),
    ],
)
def test_reading_alike(a, b, same):
    assert (lookalike.canonical(a) == lookalike.canonical(b)) is same


def test_canonical_form_is_stable_and_stays_in_one_script():
    rng = random.Random(1)
    chars = [c for m in lookalike.MEMBERS.values() for c in m.values()] + list("bdkтщ 7★é")
    for _ in range(300):
        s = "".join(rng.choice(chars) for _ in range(rng.randrange(1, 9)))
        c = lookalike.canonical(s)
        assert lookalike.canonical(c) == c
        swapped = "".join(rng.choice(list(lookalike.MEMBERS[lookalike.CLASS_OF[x]].values())) if x in lookalike.CLASS_OF else x for x in s)
        assert lookalike.canonical(swapped) == c
    assert lookalike.canonical("Pикачо") == "Рикачо" and lookalike.canonical(None) is None


def test_the_path_decides_what_an_ambiguous_letter_is(spark):
    names = spark.createDataFrame([("Ilana",), ("Ivo",), ("Italo",), ("Gala",), ("Pola",), ("Bella",), ("Kalle",)], "name string")
    bigrams = lookalike.train_bigrams(names, "name")
    assert lookalike.canonical("ꓲvo", bigrams) == "Ivo" and lookalike.canonical("GaӀa", bigrams) == "Gala" and lookalike.canonical("PoⵏӀa", bigrams) == "Polla"
    assert lookalike.canonical("ꓖаꓡа") == lookalike.canonical("GaLa")


def test_pairs_of_alike_names(spark):
    e = spark.createDataFrame([(1, "player", "Seta", "x"), (2, "player", "Sеta", "x"), (2, "player", "Sеta", "x"), (3, "alliance", "Sеta", "x"), (4, "player", None, "x"), (5, "player", "​", "x"), (6, "player", "seta", "x")], "id bigint, kind string, name string, form string")
    r = spark.createDataFrame([(10, "player", "Seta"), (11, "player", "Sеta "), (12, "alliance", "Seta"), (13, None, "Seta"), (14, "player", None), (10, "player", "Seta")], "row_id bigint, kind string, name string")
    got = {tuple(x) for x in lookalike.lookalike_pairs(e, r, {}).collect()}
    assert got == {("entities", 1, 2), ("ranking_rows", 2, 10), ("ranking_rows", 1, 11), ("ranking_rows", 2, 11), ("ranking_rows", 3, 12)}
    assert lookalike.lookalike_pairs(e.limit(0), r, {}).count() == 0
    assert lookalike.train_bigrams(e, "name")


# --- survivors ---------------------------------------------------------------
FRAG = "id bigint, g int, name string, power bigint, c double, at timestamp, field string, value string"


def best(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FRAG)
    fields = {"name": survivors.text_value(F.col("name")), "power": survivors.positive_value(F.col("power"))}
    return {r["g"]: (r["name_from"], r["power_from"]) for r in survivors.survivors(df, ["g"], fields, "id", "c", "at").collect()}


def test_survivors_by_trust_time_and_id(spark):
    at = lambda n: T0 + dt.timedelta(days=n)
    rows = [
        (1, 1, "a", 5, 0.9, at(1)), (2, 1, "b", -1, 0.9, at(2)), (3, 1, "n/a", 7, 1.0, at(3)), (3, 1, "n/a", 7, 1.0, at(3)),
        (4, 2, " ", 0, 0.9, at(1)), (5, 2, "NULL", None, None, at(2)), (6, 3, "only", 1, 0.5, at(1)), (6, 3, "only", 1, 0.5, at(1)),
        (8, 4, "x", 1, None, at(1)), (7, 4, "y", 2, float("nan"), at(1)), (9, None, "p", 1, 0.1, at(1)), (10, None, "q", 1, 0.1, at(1)),
    ]
    assert best(spark, rows) == {1: (2, 3), 2: (None, None), 4: (7, 7), None: (9, 9)}
    assert best(spark, []) == {}


def brute_latest(rows):
    """The survivor of ``name`` in every group of more than one row, by closing the learned order over all pairs."""
    seen, votes = {}, {}
    for _, g, v, _, _, at in rows:
        if at is not None:
            seen.setdefault(g, {})[v] = min(at, seen.get(g, {}).get(v, at))
    for first in seen.values():
        order = sorted(first, key=lambda v: (first[v], v))
        for k, a in enumerate(order):
            for b in (order[k + (1 << j)] for j in range(9) if k + (1 << j) < len(order)):
                if first[a] < first[b]:
                    votes[a, b] = votes.get((a, b), 0) + 1
    less = {(a, b) for (a, b), n in votes.items() if n > votes.get((b, a), 0)}
    while True:
        more = {(a, d) for a, b in less for c, d in less if b == c} - less
        if not more:
            break
        less |= more
    out = {}
    for g in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == g]
        top = [r for r in mine if r[4] == max(x[4] for x in mine)]
        latest = {v: max(((r[5] or dt.datetime.min), -r[0]) for r in top if r[2] == v) for v in {r[2] for r in top}}
        undated = {v for v in latest if latest[v][0] == dt.datetime.min}
        left = [v for v in latest if not any((v, w) in less and (w, v) not in less and (v in undated or w in undated) for w in latest)] if any(r[5] is None for r in top) else list(latest)
        out[g] = -max(latest[v] for v in left)[1]
    return out


def test_missing_timestamps_are_reasoned_from_other_groups(spark):
    at = lambda n: T0 + dt.timedelta(days=n)
    rows = [(i * 10 + k, 100 + i, v, 1, 0.9, at(k)) for i in range(5) for k, v in enumerate(("old", "mid", "new"))]
    rows += [(900, 7, "mid", 1, 0.9, None), (901, 7, "old", 1, 0.9, None), (905, 8, "mid", 1, 0.9, at(5)), (904, 8, "old", 1, 0.9, None)]
    rows += [(910, 9, "old", 1, 0.9, None), (911, 9, "new", 1, 0.9, None), (920, 10, "new", 1, 0.9, at(1)), (921, 10, "other", 1, 0.9, None)]
    got = best(spark, rows)
    assert (got[7][0], got[8][0], got[9][0], got[10][0]) == (900, 905, 911, 920)
    assert {g: v[0] for g, v in got.items()} == brute_latest(rows)


def test_reasoned_order_against_brute_force(spark):
    rng = random.Random(4)
    at = lambda n: T0 + dt.timedelta(days=n)
    rows = []
    for g in range(60):
        values = rng.sample("abcdefgh", rng.randrange(2, 6))
        if rng.random() < 0.8:
            values.sort()
        rows += [(g * 100 + k, g, v, 1, rng.choice([0.5, 0.9, 0.9]), None if g % 3 == 0 and rng.random() < 0.7 else at(k)) for k, v in enumerate(values)]
    # one group holds far more values than a range
    rows += [(90_000 + k, 777, f"w{k:04d}", 1, 0.9, at(k)) for k in range(100)] + [(99_000, 778, "w0003", 1, 0.9, None), (98_999, 778, "w0090", 1, 0.9, None)]
    assert {g: v[0] for g, v in best(spark, rows).items()} == brute_latest([r for r in rows if r[1] < 777]) | {777: 90_099, 778: 98_999}


# --- leakage -----------------------------------------------------------------
def item(rng, n):
    return " ".join("".join(rng.choice("bcdfgklmnprstv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = {i: item(rng, rng.randrange(30, 60)) for i in range(12)} | {50: "short answer of six words", 51: "", 52: None}
    docs, want = {}, set()
    for d in range(200):
        words = item(rng, rng.randrange(0, 200)).split()
        i = rng.randrange(12)
        w = items[i].split()
        kind = d % 5
        if kind == 0:
            a = rng.randrange(len(w) - 12)
            part = w[a : a + 12]
            want.add((i, d))
        elif kind == 1:
            part = [rng.choice(["other", x]) if k % 9 == 4 else x for k, x in enumerate(w)]
            want.add((i, d))
        elif kind == 2:
            a = rng.randrange(len(w) - 11)
            part = w[a : a + 11]
        elif kind == 3:
            part = ["other" if k % 3 == 0 else x for k, x in enumerate(w)]
        else:
            part = []
        at = rng.randrange(len(words) + 1)
        text = [*words[:at], "<b>", *part, "</b>", *words[at:]]
        docs[d] = " ".join(x.upper() if d % 2 else x for x in text).replace(" ", "\n> " if d % 3 == 0 else " ")
    docs[500], docs[501], docs[502] = None, "", "So: Short answer, of six words!"
    want.add((50, 502))
    i = spark.createDataFrame([(k, v, "x") for k, v in items.items()], "item_id bigint, item_text string, text string")
    t = spark.createDataFrame([(k, v, "x") for k, v in docs.items()] + [(0, docs[0], "x")], "doc_id bigint, text string, item_text string")
    assert {tuple(r) for r in leakage.find_leaks(i, t).collect()} == want
    assert {tuple(r) for r in leakage.find_leaks(i, t, chunk=2).collect()} == want
    assert leakage.find_leaks(i.limit(0), t).count() == 0 and leakage.find_leaks(i, t.limit(0)).count() == 0


@pytest.mark.parametrize("way", ["spread", "random", "left out"])
def test_short_items_with_one_word_in_eight_changed_are_found(spark, way):
    """Every item of 6 to 64 words with as many words changed as one in eight allows is found in a longer document."""
    rng = random.Random(way)
    items, docs = {}, {}
    for i, n in enumerate([n for n in (6, 8, 12, 14, 16, 20, 24, 32, 40, 47, 48, 56, 64) for _ in range(20)]):
        words = item(rng, n).split()
        items[i] = " ".join(words)
        k = n // 8
        places = [round((j + 1) * n / (k + 1)) - 1 for j in range(k)] if way == "spread" else rng.sample(range(n), k)
        changed = ["" if x in places and way == "left out" else item(rng, 2).replace(" ", "x") if x in places else w for x, w in enumerate(words)]
        docs[i] = f"{item(rng, 40)} {' '.join(changed)} {item(rng, 40)}"
    a = spark.createDataFrame(list(items.items()), "item_id bigint, item_text string")
    b = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    found = {tuple(r) for r in leakage.find_leaks(a, b).collect()}
    sure = {(i, i) for i in items if len(items[i].split()) <= leakage.SURE_WORDS}
    assert sure <= found and len(found & {(i, i) for i in items}) >= 0.99 * len(items)


def test_an_item_behind_repeats_of_its_phrases_is_found():
    rng = random.Random(3)
    words = item(rng, 40).split()
    near = [w for k in range(12) for w in [*words[k : k + 9], "between"]]
    changed = [w if k % 9 != 4 else "other" for k, w in enumerate(words)]
    number = {w: i + 1 for i, w in enumerate({*words, "between", "other"})}
    ids = lambda x: np.array([number[w] for w in x], dtype=np.uint64)
    assert leakage.holds(ids(near + changed + near), ids(words)) and not leakage.holds(ids(near), ids(words))


def test_words_and_the_common_subsequence():
    assert plain_words("Th­e <em class='q'>Ｆｕｌｌ</em> **bold**<br/>x&amp;y") == [b"the", b"full", b"bold", b"x", b"y"]
    assert leakage.common_in_order([1, 2, 3, 4], [9, 2, 4, 1]) == 2
    h = leakage.shingle_hashes(np.array([1, 2, 3, 0, 1, 2, 3], dtype=np.uint64), 3)
    assert h[0] == h[4] and (h[1:4] == np.iinfo(np.uint64).max).all()


# --- mixing ------------------------------------------------------------------
def test_pivotal_rounding_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 2000, 400).astype(float)
    p = rng.random(400)
    out, held = mixing.pivotal(w, p, rng)
    assert abs((w * out).sum() - (w * p).sum()) < 1e-6 and ((out == 0) | (out == 1) | (np.arange(400) == held)).all()
    mean = np.mean([mixing.pivotal(np.ones(4), np.array([0.2, 0.7, 0.5, 0.6]), np.random.default_rng(s))[0] for s in range(4000)], axis=0)
    assert np.abs(mean - [0.2, 0.7, 0.5, 0.6]).max() < 0.03


@pytest.mark.parametrize("block", [50_000, 64])
def test_mixed_sources_meet_their_shares(spark, block):
    rng = random.Random(3)
    rows = [(i, ("big", "small", "mid", "unlisted", None)[min(4, int(rng.paretovariate(1.0)) - 1)], rng.randrange(0, 500)) for i in range(4000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.15, 2), ("absent", 0.05, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(counts, targets, block=block)
    shares = {r["source"]: r for r in mixing.reached_shares(mix, targets).collect()}
    for s, share, cap in (("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.15, 2)):
        assert abs(shares[s]["reached_share"] - share / 0.95) < 0.01 and shares[s]["most_copies"] <= cap
    assert shares["absent"]["reached_share"] == 0 and mix.count() == mix.select("doc_id").distinct().count() == sum(1 for r in rows if r[1] in ("big", "small", "mid"))
    assert mixing.mix_sources(counts, targets.limit(0)).count() == 0 and mixing.mix_sources(counts.limit(0), targets).count() == 0


def test_a_total_beyond_the_caps_falls_short():
    rates = mixing.plan_rates({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.5, 1)], 1000)
    assert rates == {"a": 2.0, "b": 0.5}


def test_token_counts(spark):
    pytest.importorskip("tiktoken")
    docs = spark.createDataFrame([(1, "hello world", "s", 5), (2, None, None, 5), (3, "", "s", 5), (1, "hello world", "s", 5)], "doc_id bigint, text string, source string, tokens int")
    assert {r["doc_id"]: r["tokens"] for r in mixing.token_counts(docs).collect()} == {1: 2, 2: 0, 3: 0}


# --- personal data -----------------------------------------------------------
@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("Send it to quenna84@post.example.org.", ["email:quenna84@post.example.org"]), ("mailto:a.b+s1 (at) mail.example works", ["email:a.b+s1 (at) mail.example"]),
        ("see gaston16 [at] guildmail [dot] test hoy", ["email:gaston16 [at] guildmail [dot] test"]), ("resending s606@2x-24.png.", []), ("write joe at mail dot example now", ["email:joe at mail dot example"]),
        ("Call +1 (202) 555-0124 3NFw attacks", ["phone:+1 (202) 555-0124"]), ("WhatsApp: 0044 7700 900 243\n12 rows", ["phone:0044 7700 900 243"]), ("Tel. 030/23125-795", ["phone:030/23125-795"]),
        ("phone (202) 555 0186, evenings", ["phone:(202) 555 0186"]), ("Ticket 428-94-3086 asks", []), ("He posted his tax number (QQ 71 22 53 C).", ["id_number:QQ 71 22 53 C"]), ("Su DNI 99592670X se ve", ["id_number:99592670X"]),
        ("goes to 149b Upper Marl St..", ["address:149b Upper Marl St."]), ("Address: 12 Oxbow Road, Flat 3, North Tessel ZZ9 4QK The list", ["address:12 Oxbow Road, Flat 3, North Tessel ZZ9 4QK"]),
        ("bei Lindacher Allee 94a, 05568 Bad Wellbach.", ["address:Lindacher Allee 94a, 05568 Bad Wellbach"]), ("va a C/ Vereda Honda 17, 3º C, 00635 Villaseca de Orna.", ["address:C/ Vereda Honda 17, 3º C, 00635 Villaseca de Orna"]),
        ("au 66 rue des Tilleuls-Gris, 99359 Courvieux.", ["address:66 rue des Tilleuls-Gris, 99359 Courvieux"]), ("Mr DARVO OSTROVANE signed", ["person:DARVO OSTROVANE"]), ("according to Q. Lorquin-Uxbrigg's shot", ["person:Q. Lorquin-Uxbrigg"]),
        ("Please ask John Smith or Maria Garcia", ["person:John Smith", "person:Maria Garcia"]), ("phone is 202.555.0124", ["phone:202.555.0124"]), ("IBAN DE89 3704 0044 0532 0130 00", []),
        ("mail jörg.müller@exämple.de or 메일a1@example.org", ["email:jörg.müller@exämple.de", "email:a1@example.org"]), ("Passport: X1234567, NIE X1234567L", ["id_number:X1234567", "id_number:X1234567L"]),
        ("lives at 123 Main Blvd, Springfield", ["address:123 Main Blvd, Springfield"]), ("Thanks to Harkaway, Corwen for", ["person:Harkaway, Corwen"]), ("Miru Lade moved", []), ("Quenna moved", []), ("", []), (None, []),
    ],
)
def test_places(text, found):
    assert [f"{k}:{text[a:b]}" for k, a, b in personal.find_personal(text)] == found


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("or (202) 555 0186, evenings", ["phone:(202) 555 0186"]), ("write 0044 7700 900 243 today", ["phone:0044 7700 900 243"]), ("or +49 30 1234567.", ["phone:+49 30 1234567"]),
        ("or +44 (0)20 7946 0958.", ["phone:+44 (0)20 7946 0958"]), ("at 10:00 12345678 rows, 1.00 49301234567, Tessel 00917 and", []), ("rows (2024) 12 and (551) 416693161-2/3", []),
        ("Mrs Anna Schmidt signed", ["person:Anna Schmidt"]), ("Contact: J. van Dyke", ["person:J. van Dyke"]), ("Contact: J. Miller-Hart, late", ["person:J. Miller-Hart"]), ("Dr. Ludwig van Moor's list", ["person:Ludwig van Moor"]),
        ("reported by K. Tanaka today", ["person:K. Tanaka"]), ("Thanks to Miru Lade for it", []), ("Mr Jean Paul Sartre, late", ["person:Jean Paul Sartre"]), ("Madame, Monsieur Le Roux", ["person:Le Roux"]),
    ],
)
def test_places_outside_the_lists(text, found):
    assert [f"{k}:{text[a:b]}" for k, a, b in personal.find_personal(text)] == found


def test_redaction_and_long_texts(spark):
    long = "The list is late. " * 200_000 + "mail: a1@example.org"
    docs = spark.createDataFrame([(1, "꿈 Call +34 600 000 630 or a1@example.org", 9), (2, None, 9), (3, long, 9), (1, "꿈 Call +34 600 000 630 or a1@example.org", 9)], "doc_id bigint, text string, start_at int")
    got = {tuple(r) for r in personal.personal_places(docs).collect()}
    assert got == {(1, "phone", 7, 22), (1, "email", 26, 40), (3, "email", len(long) - 14, len(long))}
    red = {r["doc_id"]: r["text"] for r in personal.redacted_documents(docs.limit(2)).collect()}
    assert red == {1: "꿈 Call [PHONE] or [EMAIL]", 2: None}
    assert personal.personal_places(docs.limit(0)).count() == 0


def test_survivors_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    try:
        con.execute(f"create view fragments as select * from read_parquet('{path}/fragments.parquet')")
    except duckdb.Error:
        pytest.skip("test tables are not here")
    for name in ("p6_found", "p6_records"):
        df = queries.QUERIES[name](spark, path)
        cursor = con.execute(queries.SQL[name])
        order = [c[0] for c in cursor.description]
        assert {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()} == {tuple(r[order.index(c)] for c in sorted(order)) for r in cursor.fetchall()}
