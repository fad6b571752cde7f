"""Orphans, history, control charts and snapshot changes against brute force on small fixtures."""

import datetime as dt
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from ladderlake.functions.medians import grouped_median
from ladderlake.operators.control_chart import ChartSettings, flag_readings
from ladderlake.operators.history import attribute_history
from ladderlake.operators.orphans import orphan_references, orphan_report
from ladderlake.operators.snapshot_delta import SnapshotIndex, diff_series, differences_at_once

T0 = dt.datetime(2025, 1, 1)


def day(n):
    return dt.date(2025, 1, 1) + dt.timedelta(days=n)


def at(n):
    return T0 + dt.timedelta(days=n)


PARENTS = "id bigint, status string, created_at timestamp, extra string"
CHILDREN = "id bigint, ref bigint, created_at timestamp, status string"


def test_orphans_kinds_nulls_repeats_and_clashing_columns(spark):
    parents = spark.createDataFrame(
        [(1, "active", at(0), "x"), (1, "active", at(0), "x"), (2, " DELETED ", at(0), None), (3, None, at(40), None), (64, "active", None, None), (-5, "active", at(0), None)], PARENTS
    )
    children = spark.createDataFrame(
        [
            (10, 1, at(35), "deleted"), (11, 2, at(35), None), (12, 3, at(35), None), (13, 3, at(50), None), (14, 99, at(35), None), (14, 99, at(35), None),
            (15, None, at(35), None), (16, 64, at(1), None), (17, -5, at(1), None), (18, -6, at(1), None), (19, 99, None, None), (20, 1, None, None), (21, 3, None, None),
        ],
        CHILDREN,
    )
    out = orphan_references([("c", children, "id", "ref")], parents)
    got = sorted((r["row_id"], r["kind"], r["period"]) for r in out.collect())
    assert got == [(11, "deleted", "2025-02"), (12, "late", "2025-02"), (14, "missing", "2025-02"), (18, "missing", "2025-01"), (19, "missing", None)]
    assert {(r["period"], r["orphans"]) for r in orphan_report(out).where("kind = 'missing'").collect()} == {("2025-02", 1), ("2025-01", 1), (None, 1)}


def test_orphans_with_text_keys_use_a_dictionary(spark):
    parents = spark.createDataFrame([("a", "active", at(0)), ("b", "deleted", at(0))], "id string, status string, created_at timestamp")
    children = spark.createDataFrame([(1, "a", at(40)), (2, "b", at(40)), (3, "zz", at(40)), (4, None, at(40))], "id bigint, ref string, created_at timestamp")
    got = {(r["row_id"], r["kind"]) for r in orphan_references([("c", children, "id", "ref")], parents).collect()}
    assert got == {(2, "deleted"), (3, "missing")}


def test_orphans_of_empty_tables(spark):
    none = spark.createDataFrame([], PARENTS)
    assert orphan_references([("c", spark.createDataFrame([], CHILDREN), "id", "ref")], none).count() == 0
    one = spark.createDataFrame([(1, 5, at(1), None)], CHILDREN)
    assert [r["kind"] for r in orphan_references([("c", one, "id", "ref")], none).collect()] == ["missing"]


def brute_history(rows):
    """rows: (key, day, received, tie, ended, state)"""
    last = {}
    for k, d, r, t, e, s in rows:
        if (k, d) not in last or (r, t) > last[k, d][:2]:
            last[k, d] = (r, t, e, s)
    out, live = [], {}
    for (k, d), (_, _, e, s) in sorted(last.items(), key=lambda x: (x[0][0], x[0][1])):
        if k in live and (e or live[k][1] != s):
            out.append((k, live[k][0], d, live.pop(k)[1]))
        if not e and k not in live:
            live[k] = (d, s)
    return sorted([*out, *[(k, d, None, s) for k, (d, s) in live.items()]], key=str)


def test_history_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        ended = rng.random() < 0.15
        rows.append((rng.randrange(12), day(rng.randrange(15)), at(rng.randrange(40)), i, ended, (rng.choice(["A", "B", None]), rng.choice(["x", "y"]))))
    flat = [(k, d, r, t, "retire" if e else "upsert", s[0], s[1], "clash") for k, d, r, t, e, s in rows]
    df = spark.createDataFrame(flat + flat[:20], "entity_id bigint, d date, r timestamp, u bigint, kind string, tag string, name string, valid_from string")
    got = attribute_history(df, ["entity_id"], "d", "r", "u", ["tag", "name"], F.col("kind") == "retire").collect()
    have = sorted([(g["entity_id"], dt.date.fromisoformat(g["valid_from"]), None if g["valid_to"] == "9999-12-31" else dt.date.fromisoformat(g["valid_to"]), (g["tag"], g["name"])) for g in got], key=str)
    assert have == brute_history(rows)


def test_history_of_nothing_and_of_missing_dates(spark):
    schema = "k string, d date, r timestamp, u bigint, v string"
    assert attribute_history(spark.createDataFrame([], schema), ["k"], "d", "r", "u", ["v"]).count() == 0
    df = spark.createDataFrame([("a", None, at(1), 1, "x"), (None, day(1), None, 2, "y"), (None, day(1), at(0), 1, "z")], schema)
    assert [(r["k"], r["v"], r["valid_to"]) for r in attribute_history(df, ["k"], "d", "r", "u", ["v"]).collect()] == [(None, "z", "9999-12-31")]


def brute_cases(rows, fields):
    """rows: (row_id, source, rank, at, {field: value})"""
    once = {r[0]: r for r in rows}.values()
    series, changes, out = {}, {}, set()
    for rid, s, k, t, values in sorted(once, key=lambda r: (str(r[1]), str(r[2]), r[3], r[0])):
        for f in fields:
            if values.get(f) is not None:
                series.setdefault((s, k, f), []).append((rid, values[f]))
    for (s, _, f), xs in series.items():
        if f == "power":
            v = [x for _, x in xs if x > 0]
            changes.setdefault(s, []).extend(abs(b - a) / a for a, b in zip(v, v[1:]) if a != b)
    for (s, _, f), xs in series.items():
        v = [x for _, x in xs]
        habit = median(changes[s]) if changes.get(s) else None
        same = [i > 0 and v[i] == v[i - 1] for i in range(len(v))]
        for i, (rid, x) in enumerate(xs):
            a = b = i
            while same[i] and a - 1 > 0 and same[a - 1]:
                a -= 1
            while same[i] and b + 1 < len(v) and same[b + 1]:
                b += 1
            sides = [w for w in (v[max(0, i - 3) : i], v[i + 1 : i + 4]) if w]
            spike = habit and sides and all(abs(x - median(w)) > 12 * habit * abs(median(w)) for w in sides)
            if x <= 0 or (same[i] and b - a + 1 >= 3) or spike:
                out.add((rid, f))
    return out


def chart_rows():
    rng, rows, rid = random.Random(9), [], 0
    for s in ("a", "b", None, "hot"):
        for rank in (1, 2, None):
            level = rng.randrange(10**6, 10**8)
            for t in range(120 if s == "hot" else 25):
                rid += 1
                level = int(level * (1 + rng.uniform(0.001, 0.01)))
                if rng.random() < 0.03:
                    level *= 3  # a lasting change
                p = level
                u = rng.random()
                p = p * 10 if u < 0.04 else p // 10 if u < 0.06 else rng.choice([0, -1]) if u < 0.08 else p
                if rng.random() < 0.12 and rows:
                    p = rows[-1][4]["power"] or p
                hero = None if rng.random() < 0.2 else p
                rows.append((rid, s, rank, at(t), {"power": None if rng.random() < 0.05 else p, "hero": hero}))
    return rows


@pytest.mark.parametrize("hot_rows", [500_000, 90])
def test_control_chart_equals_the_written_rule(spark, hot_rows):
    rows = chart_rows()
    flat = [(r, s, k, t, v["power"], v["hero"], 7) for r, s, k, t, v in rows]
    df = spark.createDataFrame(flat + flat[::5], "row_id bigint, source_file string, rank int, captured_at timestamp, power bigint, hero bigint, habit int")
    got = flag_readings(df, ["power", "hero"], "power", settings=ChartSettings(hot_rows=hot_rows))
    assert {(r["row_id"], r["field_name"]) for r in got.collect()} == brute_cases(rows, ["power", "hero"])


def test_control_chart_of_nothing(spark):
    df = spark.createDataFrame([], "row_id bigint, source_file string, rank int, captured_at timestamp, power bigint")
    assert flag_readings(df, ["power"], "power").count() == 0
    one = spark.createDataFrame([(1, "s", 1, at(0), None), (2, "s", 1, at(1), 5)], "row_id bigint, source_file string, rank int, captured_at timestamp, power bigint")
    assert flag_readings(one, ["power"], "power").count() == 0


def test_grouped_median_is_exact(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([rng.random(), 0.25, 3e-9, 1e12])) for g in "abc" for _ in range(rng.randrange(1, 60))] + [("d", None)]
    got = {r["g"]: r["median"] for r in grouped_median(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {g: median([v for h, v in rows if h == g]) for g in "abc"}


SNAP = "delivery_id bigint, board string, taken_on date, received_at timestamp, identifier string, name string, server int, alliance string, power double, payload string"


def snap(d, on, rec, rows, board="b"):
    return [(d, board, day(on), at(rec), i, n, s, a, p, "clash") for i, n, s, a, p in rows]


def test_differences_between_neighbouring_dates(spark):
    rows = (
        snap(1, 0, 0, [("x", "X", 1, "A", 1.0), ("y", "Y", 1, "", 2.0), ("z", "Z", 1, "A", 3.0), (None, "N", 1, "A", 1.0)])
        + snap(2, 7, 7, [("x", "wrong", 9, "A", 1.0)])
        + snap(3, 7, 8, [("x", "X", 2, "A", 1.0), ("y", "Y", 1, None, 2.0000000001), ("w", "W", 1, None, None), ("w", "W", 1, None, None), (None, "N2", 1, "A", 1.0)])
        + snap(4, 14, 15, [("x", "X", 2, "A", 1.5), ("y", "Y", 1, " ", 2.0), (None, "N2", 1, "A", 1.0)])
        + snap(5, 0, 0, [("only", "O", 1, None, 1.0)], "c")
    )
    got = {(r["board"], r["to_date"], r["identifier"], r["difference_type"]) for r in diff_series(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {
        ("b", "2025-01-08", "x", "Moved"), ("b", "2025-01-08", "z", "Removed"), ("b", "2025-01-08", "w", "Added"), ("b", "2025-01-08", None, "Modified"),
        ("b", "2025-01-15", "x", "Modified"), ("b", "2025-01-15", "w", "Removed"),
    }
    assert diff_series(spark.createDataFrame([], SNAP)).count() == 0


def changed(df):
    return {(r["board"], str(r["from_date"]), str(r["to_date"]), r["identifier"], r["difference_type"]) for r in df.collect()}


def test_index_keeps_boards_that_are_not_delivered(spark, tmp_path):
    path = str(tmp_path / "index")
    index = SnapshotIndex(spark, path, buckets=4)
    make = lambda rows: spark.createDataFrame(rows, SNAP)
    first = index.apply(make(snap(1, 0, 0, [("x", "X", 1, "A", 1.0), ("y", "Y", 1, "", 2.0)]) + snap(2, 0, 0, [("x", "X", 1, "A", 1.0)], "c")))
    assert first.count() == 0
    second = index.apply(make(snap(3, 7, 7, [("x", "X", 2, "A", 1.0), ("w", "W", 1, None, 4.0), ("w", "V", 1, None, 4.0)])))
    assert changed(second) == {("b", "2025-01-01", "2025-01-08", "x", "Moved"), ("b", "2025-01-01", "2025-01-08", "y", "Removed"), ("b", "2025-01-01", "2025-01-08", "w", "Added")}
    # another session's view of the same folder; board c still has its first snapshot
    again = SnapshotIndex(spark, path)
    assert again.buckets == 4
    third = again.apply(make(snap(4, 14, 14, [("x", "X", 1, "A", 1.5), (None, "N", 1, None, 1.0)], "c") + snap(5, 14, 14, [("x", "X", 2, "A", 1.0), ("w", "W", 1, None, 4.0)])))
    assert changed(third) == {("c", "2025-01-01", "2025-01-15", "x", "Modified"), ("c", "2025-01-01", "2025-01-15", None, "Added")}
    assert changed(second) and sorted(p.name for p in (tmp_path / "index" / "entries").iterdir()) == ["g3"]


def test_probing_the_index_moves_no_snapshot(spark, tmp_path):
    index = SnapshotIndex(spark, str(tmp_path / "index"), buckets=4)
    for n in (1, 2):
        index.apply(spark.createDataFrame(snap(n, 7 * n, 7 * n, [(f"i{k}", "X", k + n, "A", 1.0) for k in range(50)]), SNAP))
    due = spark.createDataFrame([("b", day(7), day(14))], "board string, from_date date, to_date date")
    index._write(spark.createDataFrame(snap(3, 21, 21, [("i1", "X", 1, "A", 1.0)]), SNAP), 3)
    plan = index._probe(index._entries(3), index._entries(2), F.broadcast(due))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_series_against_a_plain_comparison(spark):
    rng = random.Random(7)
    rows, state, last = [], {}, {}
    want = set()
    for n in range(5):
        for b in "abc":
            if n and rng.random() < 0.3:
                continue
            new = {f"i{k}": (rng.choice("XY"), rng.randrange(2), rng.choice(["A", None]), float(rng.randrange(2))) for k in rng.sample(range(12), 8)}
            rows += snap(len(rows), 7 * n, 7 * n, [(i, *v) for i, v in new.items()], b)
            if b in state:
                for i in state[b].keys() | new.keys():
                    o, w = state[b].get(i), new.get(i)
                    kind = "Added" if o is None else "Removed" if w is None else "Moved" if o[1:3] != w[1:3] else "Modified" if o != w else None
                    if kind:
                        want.add((b, str(last[b]), str(day(7 * n)), i, kind))
            state[b], last[b] = new, day(7 * n)
    df = spark.createDataFrame(rows, SNAP)
    assert changed(diff_series(df)) == want and changed(differences_at_once(df)) == want
