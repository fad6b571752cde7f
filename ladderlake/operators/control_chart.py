"""Implausible spikes in measurements.

Every series (source, position, measurement) is followed by a robust
exponentially weighted control chart of mean and scale, whose limits start from
the source's own habit and narrow to the scale of the series.  A suspected value
is clipped to the limit before it moves mean and scale, so an outlier cannot
hide the next one.  Run-length counters find stuck values and
physical limits find impossible ones.  What the chart suspects is then decided
by an exact look at the neighbouring readings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions.medians import grouped_median

#: Stands for a null on the way to Python, where a column with nulls would lose the last digits of large integers.
NOTHING = -(2**63)
REACH = 3  # readings looked at on either side, and the repeats that make a run


@dataclass(frozen=True)
class ChartSettings:
    """``factor``: multiple of the source's median relative change beyond which a reading is a spike.

    ``limit``: widest chart limit in the same unit; ``spread``: chart limit as a
    multiple of the series' scale, which never falls below ``calm`` of the habit;
    ``alpha``: weight of the newest reading; ``unruly``: median relative change from which on the chart's limits
    are too wide to be a superset of the exact rule, so that all readings of the
    source go to the exact check; ``floor``: largest impossible reading;
    ``hot_rows``: rows of one source that one task may hold.
    """

    factor: float = 12.0
    limit: float = 2.0
    spread: float = 3.0
    calm: float = 0.25
    alpha: float = 0.25
    unruly: float = 0.12
    floor: float = 0.0
    hot_rows: int = 500_000


def chart_suspects(values: np.ndarray, starts: np.ndarray, habit: np.ndarray, s: ChartSettings) -> np.ndarray:
    """Readings that the exact rule must look at.

    ``values`` holds all series one after another, ``starts`` the first index
    of each, ``habit`` the median relative change of each series' source.  All
    series advance in lockstep, one reading per step.

    A reading is suspect if it leaves the chart's limits, if it is among the
    first ``REACH`` of a series, or if one of the ``REACH`` readings before it
    was suspect.  With three unsuspected readings before it, their median lies
    within limit*(1 + 3*alpha)*habit of the mean (the scale only narrows the limit), so a reading that is beyond
    factor*habit of that median is beyond limit*habit of the mean too, as long
    as the habit is below ``unruly``; the suspects hold every exact case.
    """
    n = len(values)
    out = np.zeros(n, dtype=bool)
    if n == 0:
        return out
    lengths = np.diff(np.append(starts, n))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, habit = starts[order], lengths[order], habit[order]
    mean = values[starts].astype(float)
    scale = habit * np.abs(mean)  # weighted mean of the clipped distances to the mean
    quiet = np.zeros(len(starts), dtype=int)  # unsuspected readings in a row
    run = np.zeros(len(starts), dtype=int)  # readings in a row beyond the limit on one side
    for t in range(int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        at = starts[:live] + t
        x, m, h = values[at].astype(float), mean[:live], habit[:live]
        width = np.minimum(s.limit * h * np.abs(m), s.spread * np.maximum(scale[:live], s.calm * h * np.abs(m)))
        gap = x - m
        beyond = ~(np.abs(gap) <= width) | (m <= 0)
        unsettled = quiet[:live] < REACH
        out[at] = beyond | unsettled | ~(h < s.unruly) | (x <= s.floor)
        side = np.where(beyond, np.sign(gap), 0)
        run[:live] = np.where(beyond & (np.sign(run[:live]) == side), run[:live] + side, side)
        clipped = m + np.clip(gap, -width, width)
        moved = m + s.alpha * (clipped - m)
        wider = scale[:live] + s.alpha * (np.minimum(np.abs(gap), width) - scale[:live])
        # a lasting change of level: after REACH readings beyond on one side the chart is set anew
        anew = (np.abs(run[:live]) >= REACH) | (m <= 0) | ~np.isfinite(moved)
        mean[:live] = np.where(anew, x, moved)
        scale[:live] = np.where(anew | ~np.isfinite(wider), h * np.abs(x), wider)
        quiet[:live] = np.where(beyond, 0, quiet[:live] + 1)
    return out


def exact_cases(values: np.ndarray, whole: np.ndarray, series: np.ndarray, habit: np.ndarray, suspect: np.ndarray, s: ChartSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(impossible, frozen, spike)`` by the written rule; ``whole`` are the readings as integers, ``series`` and ``habit`` are per reading."""
    n = len(values)
    impossible = values <= s.floor
    same = np.zeros(n, dtype=bool)
    if n > 1:
        same[1:] = (series[1:] == series[:-1]) & (whole[1:] == whole[:-1])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    frozen = np.zeros(n, dtype=bool)
    for a, b in edge.reshape(-1, 2)[np.diff(edge.reshape(-1, 2), axis=1)[:, 0] >= REACH]:
        frozen[a:b] = True
    spike = np.zeros(n, dtype=bool)
    at = np.flatnonzero(suspect & (habit > 0))
    if len(at):
        far = np.ones(len(at), dtype=bool)
        seen = np.zeros(len(at), dtype=bool)
        for direction in (-1, 1):
            near = np.full((len(at), REACH), np.nan)
            for k in range(1, REACH + 1):
                j = at + direction * k
                ok = (j >= 0) & (j < n)
                ok[ok] = series[j[ok]] == series[at[ok]]
                near[ok, k - 1] = values[j[ok]]
            there = ~np.isnan(near).all(axis=1)
            middle = np.full(len(at), np.nan)
            middle[there] = np.nanmedian(near[there], axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                distance = np.abs(values[at] - middle) / np.abs(middle)
            far &= ~there | (distance > s.factor * habit[at])
            seen |= there
        spike[at] = far & seen
    return impossible, frozen, spike


def _source_habit(rows: pd.DataFrame, measure: str) -> float:
    """Median relative change between successive differing readings above zero of one source."""
    ok = rows[rows[measure] > 0]
    v = ok[measure].to_numpy().astype(float)
    r = ok["__pos"].to_numpy()
    if len(v) < 2:
        return np.nan
    pair = (r[1:] == r[:-1]) & (v[1:] != v[:-1])
    change = np.abs(v[1:] - v[:-1])[pair] / v[:-1][pair]
    return float(np.median(change)) if len(change) else np.nan


def _judge(pdf: pd.DataFrame, fields: list[str], measure: str, s: ChartSettings, known_habit: bool) -> pd.DataFrame:
    """All cases of the whole sources in ``pdf``, sorted by source, position, time and id."""
    source, _ = pd.factorize(pdf["source"], use_na_sentinel=False)
    pos_raw, _ = pd.factorize(pdf["position"], use_na_sentinel=False)
    chunk = pdf["chunk"].to_numpy()
    pdf = pdf.assign(__src=source, __pos=pos_raw + source.astype("int64") * (pos_raw.max() + 1 if len(pos_raw) else 1))
    # re-sent rows have the id of the row before them
    ids, pos = pdf["row_id"].to_numpy(), pdf["__pos"].to_numpy()
    keep = np.ones(len(pdf), dtype=bool)
    keep[1:] = ~((ids[1:] == ids[:-1]) & (pos[1:] == pos[:-1]) & (chunk[1:] == chunk[:-1]))
    pdf = pdf[keep]
    if known_habit:
        habit_of = pdf["habit"].to_numpy(dtype=float)
    else:
        first = {k: _source_habit(g, measure) for k, g in pdf.groupby("__src", sort=False)}
        habit_of = pdf["__src"].map(first).to_numpy(dtype=float)
    found = []
    for f in fields:
        there = (pdf[f] != NOTHING).to_numpy()
        part = pdf[there]
        whole = part[f].to_numpy()
        v = whole.astype(float)
        habit = habit_of[there]
        key = part["__pos"].to_numpy() * 1_000_003 + part["chunk"].to_numpy()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(v) else np.zeros(0, dtype=int)
        series = np.cumsum(np.isin(np.arange(len(v)), starts))
        suspect = chart_suspects(v, starts, habit[starts], s)
        impossible, frozen, spike = exact_cases(v, whole, series, habit, suspect, s)
        hit = (impossible | frozen | spike) & ~part["halo"].to_numpy()
        if hit.any():
            found.append(
                pd.DataFrame(
                    {
                        "row_id": part["row_id"].to_numpy()[hit], "field_name": f, "value": whole[hit],
                        "impossible": impossible[hit], "frozen": frozen[hit], "spike": spike[hit],
                    }
                )
            )
    return pd.concat(found) if found else pd.DataFrame({"row_id": pd.Series(dtype="int64"), "field_name": pd.Series(dtype=str), "value": pd.Series(dtype="int64"), "impossible": pd.Series(dtype=bool), "frozen": pd.Series(dtype=bool), "spike": pd.Series(dtype=bool)})


def _whole_groups(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no group of ``column`` is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[column]
        last = key.iloc[-1]
        tail = (key.isna() if pd.isna(last) else key == last).to_numpy()
        cut = len(tail) - int(np.argmin(tail[::-1])) if not tail.all() else 0
        if cut:
            yield pd.concat([*held, batch.iloc[:cut]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held, ignore_index=True)


_OUT = "row_id bigint, field_name string, value bigint, impossible boolean, frozen boolean, spike boolean"


def flag_readings(
    rows: DataFrame,
    fields: list[str],
    measure: str,
    source: str = "source_file",
    position: str = "rank",
    row_id: str = "row_id",
    at: str = "captured_at",
    settings: ChartSettings = ChartSettings(),
) -> DataFrame:
    """Cases among the readings of ``fields``: (row_id, field_name, value, impossible, frozen, spike).

    A series is the readings of one source, position and field in order of
    ``at`` (ties by ``row_id``).  ``measure`` is the field whose changes give
    the source's habit.  Defined results: null readings and further rows of one
    id are left out; null sources and positions are values of their own; a
    source without two differing readings has no spikes; one row per row_id and
    field comes out; further columns are ignored; empty input gives no rows.

    Sources of up to ``settings.hot_rows`` rows are judged by one task each
    after a single shuffle.  Larger ones are split: their habit comes from a
    radix selection, and each series is cut into runs of time that overlap by
    the readings the rules look at.
    """
    slim = rows.select(
        F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{position}`").alias("position"),
        F.col(f"`{at}`").alias("at"), *[F.col(f"`{f}`").cast("bigint").alias(f) for f in fields],
    ).where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())
    sizes = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # at most total / hot_rows sources can be hot; the bound is checked before they go to the driver
    hot = sizes.where(F.col("n") > settings.hot_rows)
    plain = slim.withColumns({"chunk": F.lit(0), "halo": F.lit(False), "habit": F.lit(None).cast("double")})
    largest = hot.agg(F.max("n")).first()[0]
    if largest:
        names = hot.select(F.col("source").alias("__hot"))
        is_hot = F.col("source").eqNullSafe(F.col("__hot"))
        small = plain.join(names, is_hot, "left_anti")
        large = _chunked(slim.join(names, is_hot, "left_semi"), fields, measure, settings, largest)
        return _run(small, fields, measure, settings, False).unionByName(_run(large, fields, measure, settings, True))
    return _run(plain, fields, measure, settings, False)


def _run(df: DataFrame, fields: list[str], measure: str, s: ChartSettings, known_habit: bool) -> DataFrame:
    group = ["source", "position", "chunk"] if known_habit else ["source"]
    ordered = df.repartition(*[F.col(c) for c in group]).sortWithinPartitions("source", "position", "chunk", "at", "row_id", "halo")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        column = "source"
        if known_habit:
            batches = (b.assign(__unit=b["source"].astype(str) + "\0" + b["position"].astype(str) + "\0" + b["chunk"].astype(str)) for b in batches)
            column = "__unit"
        for pdf in _whole_groups(batches, column):
            yield _judge(pdf, fields, measure, s, known_habit)

    columns = ["row_id", "source", "position", "at", *fields, "chunk", "halo", "habit"]
    filled = {f: F.coalesce(F.col(f), F.lit(NOTHING).cast("bigint")) for f in fields}
    return ordered.select(*columns).withColumns(filled).mapInPandas(judge, _OUT)


def _chunked(hot: DataFrame, fields: list[str], measure: str, s: ChartSettings, largest: int) -> DataFrame:
    """Rows of hot sources with their habit, cut into chunks of time that overlap.

    A series gets so many chunks that none of the ``largest`` source's holds more
    than about an eighth of ``hot_rows``.
    """
    pieces = max(8, -(-8 * largest // s.hot_rows))
    key = ["source", "position"]
    one = hot.groupBy("row_id", *key, "at").agg(*[F.first(f, ignorenulls=True).alias(f) for f in fields])
    micros = F.unix_micros("at")
    tiles = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(micros, [i / pieces for i in range(1, pieces)], max(1000, 4 * pieces)).alias("edges"))
    use = F.when(F.col("n") > s.hot_rows // 4, F.array_distinct("edges")).otherwise(F.array().cast("array<bigint>"))
    nullsafe = F.col("source").eqNullSafe(F.col("s2")) & F.col("position").eqNullSafe(F.col("p2"))
    marked = one.join(tiles.select(F.col("source").alias("s2"), F.col("position").alias("p2"), use.alias("edges")), nullsafe).drop("s2", "p2")
    placed = marked.withColumn("chunk", F.size(F.filter("edges", lambda e: e < F.unix_micros("at")))).drop("edges")
    # the habit: successive differing readings above zero, inside chunks and across their seams
    last = _edge_rows(placed.where(f"{measure} > 0"), key, [measure], 1, forward=False)
    w = W.partitionBy(*key, "chunk").orderBy("at", "row_id")
    pairs = placed.where(f"{measure} > 0").withColumn("halo", F.lit(False)).unionByName(last.where(f"{measure} > 0"), allowMissingColumns=True)
    change = F.abs(F.col(measure) - F.col("before")) / F.col("before")
    changes = pairs.withColumn("before", F.lag(measure).over(w)).where(f"not halo and before <> {measure}").select("source", change.alias("change"))
    habits = grouped_median(changes.withColumn("source", F.coalesce("source", F.lit("\0"))), "source", "change")
    full = placed.withColumn("halo", F.lit(False))
    for f in fields:
        full = full.unionByName(_edge_rows(placed, key, fields, REACH, True, f)).unionByName(_edge_rows(placed, key, fields, REACH, False, f))
    # a halo row may serve several fields; it comes once per chunk
    full = full.groupBy("row_id", *key, "at", "chunk").agg(F.min("halo").alias("halo"), *[F.first(f, ignorenulls=True).alias(f) for f in fields])
    joined = full.join(habits.select(F.col("source").alias("s2"), F.col("median").alias("habit")), F.coalesce("source", F.lit("\0")) == F.col("s2"), "left")
    return joined.select("row_id", "source", "position", "at", *fields, F.col("chunk").cast("int").alias("chunk"), "halo", "habit")


def _edge_rows(placed: DataFrame, key: list[str], fields: list[str], reach: int, forward: bool, of: str | None = None) -> DataFrame:
    """The ``reach`` readings next to each chunk, as halo rows of that chunk.

    ``forward``: the first readings of a chunk go to the chunk before it;
    otherwise the last ones go to the chunk after it.  Chunks are cut at
    distinct times, and each holds at least one reading of the series; where a
    chunk holds fewer than ``reach``, those of the chunks beyond are taken too.
    """
    of = of or fields[0]
    order = [F.col("at"), F.col("row_id")] if forward else [F.col("at").desc(), F.col("row_id").desc()]
    w = W.partitionBy(*key, "chunk").orderBy(*order)
    near = placed.where(F.col(of).isNotNull()).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= reach)
    step = F.explode(F.sequence(F.lit(1), F.lit(reach)))
    moved = near.withColumn("__step", step).withColumn("chunk", F.col("chunk") + (-F.col("__step") if forward else F.col("__step"))).where("chunk >= 0")
    again = moved.withColumn("__m", F.row_number().over(W.partitionBy(*key, "chunk").orderBy(*order))).where(F.col("__m") <= reach)
    return again.withColumn("halo", F.lit(True)).drop("__n", "__step", "__m")
