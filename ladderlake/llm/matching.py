"""Matching entities across sources without keys.

Both sides become bags of tokens over all their attributes: letter trigrams and
the whole of a name's skeleton, the alliance tag, leading and closing digits and
a coarse size of the power.  Records of one scope meet in blocks: a block of the
left and a shard of the right side build one inverted index each and query each
other's under BM25, where an exact top-k search prunes postings that cannot reach
the k-th best score.  A pair whose records are each other's nearest is judged by
a logistic function of its scores, of the gap to the runner-up and of how the
attributes agree, calibrated on pairs that are known to be right or wrong.
Records left over search again among what is not taken.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderlake.session import cut

K1, B = 1.2, 0.3
#: Tokens of a query whose postings give the first bound on its k-th best score.
SEEDS = 6
#: Places of each record that are listed; the mutual test needs the first, the gap the second.
NEAR = 4
#: Records of one scope that meet in one task from either side; larger scopes are cut into blocks and shards.
BLOCK_ROWS = 8_192
#: Cells that document frequencies are counted in: tokens that share one share their count, so the table is bounded.
CELLS = 1 << 21
#: Postings that are added up at a time.
BATCH_POSTINGS = 1_000_000
#: Queries whose first and second places are labelled to fit the calibration; the bound keeps the driver's part fixed.
CALIBRATION_ROWS = 4_000
#: Evidence of a pair, and the weights the calibration starts from (the last one is the constant).
EVIDENCE = ("share", "back_share", "gap", "alike", "letters", "same_digits", "rounded", "close", "apart", "tag_same", "tag_other", "added", "added_close")
PRIOR = np.array([2.0, 2.0, 1.0, 4.0, 2.0, 4.0, 3.0, 1.0, -2.0, 1.5, -1.0, -3.0, -1.0, -5.5])
# Characters that screen reading confuses, and the one they are read as here.
CONFUSED = str.maketrans({"0": "o", "1": "l", "i": "l", "2": "z", "5": "s", "6": "b", "8": "b", "9": "g", "v": "u", "c": "e", "f": "t"})
# Fixed value: endings that tell a second account of a player, in skeleton letters.
SECOND_ACCOUNT = "^(?:[a-wyz]|[0-9]{1,2}|ll|lll|alt|tarm|jr|bank|mlnl)$"
_TAG = re.compile(r"^\s*\[([^\[\]]{1,6})\]\s*")
_CUT = re.compile(r"(\.{2,}|…)\s*$")


def skeleton(name: str | None) -> str:
    """Lower-case letters and digits without accents, blanks and tag, confused characters made one; a cut name ends in '…'."""
    if not name:
        return ""
    cut_off = bool(_CUT.search(name))
    text = _CUT.sub("", _TAG.sub("", name))
    text = "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c) and c.isalnum())
    text = text.replace("rn", "m").translate(CONFUSED)
    return text + ("…" if cut_off else "")


@F.pandas_udf(T.StringType())
def _skeleton_udf(names: pd.Series) -> pd.Series:
    return pd.Series([skeleton(n) for n in names], dtype=object)


def _tokens(skel: Column, tag: Column, power: Column) -> Column:
    """Hashes of the distinct tokens over all attributes."""
    body = F.regexp_replace(skel, "…", "")
    padded = F.concat(F.lit("^"), body, F.when(skel.endswith("…"), F.lit("")).otherwise(F.lit("$")))
    grams = F.when(
        F.length(body) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.concat(F.lit("n:"), F.substring(padded, i, F.lit(3))))
    )
    digits = F.when(power > 0, power.cast("bigint").cast("string"))
    size = F.when(power > 0, F.when(power < 1_000_000, power * 1000).otherwise(power))
    bucket = F.floor(F.log(size) * 40)
    extra = F.array(
        F.when(F.length(body) > 0, F.concat(F.lit("w:"), body)),
        F.when(tag.isNotNull(), F.concat(F.lit("t:"), F.lower(tag))),
        F.concat(F.lit("h:"), F.substring(digits, 1, 4)),
        F.when((F.length(digits) > 4) & ~digits.endswith("0000"), F.concat(F.lit("e:"), F.substring(digits, -4, 4))),
        F.concat(F.lit("b:"), bucket.cast("string")),
        F.concat(F.lit("b:"), (bucket + 1).cast("string")),
    )
    every = F.concat(F.coalesce(grams, F.array().cast("array<string>")), F.array_compact(extra))
    return F.array_distinct(F.transform(every, lambda t: F.xxhash64(t)))


SAME = ["scope", "name", "tag", "power"]


def records(rows: DataFrame, row_id: str, server: str, name: str, tag: str, power: str) -> DataFrame:
    """Canonical records (id, scope, name, tag, power), one per id; the tag may stand in front of the name."""
    one = rows.select(
        F.col(f"`{row_id}`").cast("bigint").alias("id"), F.col(f"`{server}`").cast("bigint").alias("scope"), F.col(f"`{name}`").alias("name"),
        F.col(f"`{tag}`").alias("tag"), F.col(f"`{power}`").cast("double").alias("power"),
    ).where("id is not null").dropDuplicates(["id"])
    in_front = F.regexp_extract(F.coalesce("name", F.lit("")), r"^\s*\[([^\[\]]{1,6})\]", 1)
    return one.withColumn("tag", F.coalesce(F.nullif(F.trim("tag"), F.lit("")), F.nullif(in_front, F.lit(""))))


def representatives(side: DataFrame) -> DataFrame:
    """One record (the smallest id) for all that are equal in every attribute, with its skeleton and tokens."""
    one = side.groupBy(*SAME).agg(F.min("id").alias("id")).withColumn("skel", _skeleton_udf("name"))
    return one.withColumn("tokens", _tokens(F.col("skel"), F.col("tag"), F.col("power")))


@dataclass
class Statistics:
    """Counts over all records of a side; document frequencies are kept by cell."""

    n: int
    mean_length: float
    idf: np.ndarray

    def saturation(self, lengths: np.ndarray) -> np.ndarray:
        return (K1 + 1) / (1 + K1 * (1 - B + B * lengths / max(self.mean_length, 1e-9)))


def statistics(side: DataFrame) -> Statistics:
    n, total = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    cells = side.select(F.explode("tokens").alias("t")).groupBy(F.pmod("t", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("df")).toArrow()  # at most CELLS rows
    df = np.zeros(CELLS, dtype=np.float32)
    df[cells["cell"].to_numpy()] = cells["df"].to_numpy()
    return Statistics(n, total / n if n else 0.0, np.log(1 + (n - np.minimum(df, n) + 0.5) / (df + 0.5)).astype(np.float32))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, … of every stretch, one stretch after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@dataclass
class Bags:
    """Token bags of one side in a block; tokens are numbered across both sides."""

    ids: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    weight: np.ndarray  # of each token when this side is the index
    saturation: np.ndarray

    def __post_init__(self) -> None:
        record = np.repeat(np.arange(len(self.ids)), self.lengths)
        order = np.argsort(self.tokens, kind="stable")
        self.postings = record[order]
        self.df = np.bincount(self.tokens, minlength=len(self.weight))
        self.first = np.cumsum(self.df) - self.df
        self.keys = self.tokens[order] * max(len(self.ids), 1) + self.postings
        self.most = np.zeros(len(self.weight))
        np.maximum.at(self.most, self.tokens, self.saturation[record])
        self.most *= self.weight


def pair_scores(asked: Bags, index: Bags, q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """BM25 score of each pair: every token of the query is looked up in the record's postings."""
    lengths = asked.lengths[q]
    token = asked.tokens[_spread(asked.starts[q], lengths)]
    pair = np.repeat(np.arange(len(q)), lengths)
    key = token * max(len(index.ids), 1) + d[pair]
    at = np.searchsorted(index.keys, key)
    at[at == len(index.keys)] = 0
    there = index.keys[at] == key if len(index.keys) else np.zeros(len(key), dtype=bool)
    return np.bincount(pair[there], index.weight[token[there]], minlength=len(q)) * index.saturation[d]


def _ranks(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """1, 2, … within each group in the order of ``keys``."""
    order = np.lexsort((*reversed(keys), group))
    g = group[order]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    out = np.empty(len(g), dtype=np.int64)
    out[order] = np.arange(len(g)) - start + 1
    return out


def _added(index: Bags, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, record, sum) over the postings of ``t``."""
    n = max(len(index.ids), 1)
    d = index.postings[_spread(index.first[t], index.df[t])]
    keys, at = np.unique(np.repeat(q, index.df[t]) * n + d, return_inverse=True)
    sums = np.bincount(at, np.repeat(index.weight[t], index.df[t]) * index.saturation[d], minlength=len(keys))
    return keys // n, keys % n, sums


def top_k(asked: Bags, index: Bags, k: int, seeds: int = SEEDS) -> tuple[np.ndarray, np.ndarray]:
    """The k best records of the index for every query, exactly; ties fall to the smallest id.

    The postings of a query's rarest tokens give a lower bound on its k-th best
    score.  Tokens whose greatest contributions together stay below that bound
    cannot bring in a record by themselves; only the others' postings are read,
    and what can still reach the bound is scored in full.
    """
    owner = np.repeat(np.arange(len(asked.ids)), asked.lengths)
    there = index.df[asked.tokens] > 0
    q, t = owner[there], asked.tokens[there]
    work = np.cumsum(np.bincount(q, index.df[t], minlength=len(asked.ids)))
    found_q, found_d = [], []
    first = 0
    while first < len(asked.ids):
        done = work[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(work, done + BATCH_POSTINGS, side="right")))
        lo, hi = np.searchsorted(q, [first, last])
        cq, ct = q[lo:hi], t[lo:hi]
        first = last
        rare = _ranks(cq, index.df[ct], ct) <= seeds
        sq, _, low = _added(index, cq[rare], ct[rare])
        floor = np.zeros(last)
        kth = _ranks(sq, -low) == k
        floor[sq[kth]] = low[kth] * 0.999999
        order = np.lexsort((index.most[ct], cq))
        cq, ct = cq[order], ct[order]
        grown = np.cumsum(index.most[ct])
        before = np.r_[0.0, grown][np.searchsorted(cq, cq)]
        spare = grown - before < floor[cq]
        slack = np.bincount(cq[spare], index.most[ct[spare]], minlength=last)
        pq, pd_, partial = _added(index, cq[~spare], ct[~spare])
        alive = partial + slack[pq] >= floor[pq]
        pq, pd_ = pq[alive], pd_[alive]
        score = np.round(pair_scores(asked, index, pq, pd_), 6)
        best = _ranks(pq, -score, index.ids[pd_]) <= k
        found_q.append(pq[best])
        found_d.append(pd_[best])
    return (np.concatenate(found_q), np.concatenate(found_d)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def block_pairs(left: pa.Table, right: pa.Table, of_left: Statistics, of_right: Statistics, k: int) -> pa.Table:
    """(q, d, share, back_share) of the k best of each record in a block, from either side; a share is a score over the record's own."""

    def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = t["tokens"].combine_chunks()
        lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        tokens = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        pool = t["pool"].to_numpy().astype(np.int64)
        return t["id"].to_numpy(), tokens, lengths, np.repeat(pool, lengths)

    schema = pa.schema([("q", pa.int64()), ("d", pa.int64()), ("share", pa.float64()), ("back_share", pa.float64())])
    if not len(left) or not len(right):
        return schema.empty_table()
    (l_id, l_tok, l_len, l_pool), (r_id, r_tok, r_len, r_pool) = flat(left), flat(right)
    raw = np.concatenate([l_tok, r_tok])
    with np.errstate(over="ignore"):
        apart = raw ^ (np.concatenate([l_pool, r_pool]) * np.int64(0x1E3779B97F4A7C15))  # pools that share a task share no token
    _, at, number = np.unique(apart, return_index=True, return_inverse=True)
    cell = raw[at] % CELLS

    def bags(ids: np.ndarray, tokens: np.ndarray, lengths: np.ndarray, of: Statistics) -> Bags:
        return Bags(ids, tokens, np.cumsum(lengths) - lengths, lengths, of.idf[cell].astype(float), of.saturation(lengths))

    lb, rb = bags(l_id, number[: len(l_tok)], l_len, of_left), bags(r_id, number[len(l_tok) :], r_len, of_right)
    q, d = top_k(lb, rb, k)
    d2, q2 = top_k(rb, lb, k)
    n = len(r_id)
    keys = np.unique(np.r_[q * n + d, q2 * n + d2])
    q, d = keys // n, keys % n
    own = lambda b, w: np.maximum(np.bincount(np.repeat(np.arange(len(b.ids)), b.lengths), w[b.tokens], minlength=len(b.ids)), 1e-9)
    share = np.round(pair_scores(lb, rb, q, d) / own(lb, rb.weight)[q], 9)
    back = np.round(pair_scores(rb, lb, d, q) / own(rb, lb.weight)[d], 9)
    return pa.table([l_id[q], r_id[d], share, back], schema=schema)


def nearest(left: DataFrame, right: DataFrame, of_left: Statistics, of_right: Statistics, k: int = NEAR, block: int = BLOCK_ROWS) -> DataFrame:
    """(q, d, share, back_share): every pair in which one record is among the other's k best of its scope.

    Records without scope meet those of all scopes.  Scopes of up to ``block``
    records a side share tasks; larger ones are cut into blocks of the left and
    shards of the right side, each of which meets each.
    """
    spark = left.sparkSession
    slim = lambda df, pool: df.select("id", pool.alias("pool"), "tokens")
    scoped, free = F.col("scope").isNotNull(), F.col("scope").isNull()
    own = F.xxhash64(F.lit("scope"), "scope")
    nobody_left, nobody_right = F.xxhash64(F.lit("left without scope")), F.xxhash64(F.lit("right without scope"))
    counts = {side: df.where(free).limit(1).count() for side, df in (("left", left), ("right", right))}
    lefts, rights = [slim(left.where(scoped), own)], [slim(right.where(scoped), own)]
    if counts["left"]:
        lefts.append(slim(left.where(free), nobody_left))
        rights.append(slim(right, nobody_left))
    if counts["right"]:
        lefts.append(slim(left.where(scoped), nobody_right))
        rights.append(slim(right.where(free), nobody_right))
    lefts, rights = reduce(DataFrame.unionByName, lefts), reduce(DataFrame.unionByName, rights)
    sizes = (
        lefts.select("pool", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(rights.select("pool", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("pool").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(f"a > {block} or b > {block}")
        .select("pool", F.ceil(F.col("a") / block).alias("blocks"), F.ceil(F.col("b") / block).alias("shards"))
    )
    packs = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(of_left.n + of_right.n) // block))

    def keyed(rows: DataFrame, mine: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id"), F.coalesce(mine, F.lit(1)))
        spread = rows.join(sizes, "pool", "left").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.coalesce(other, F.lit(1)), F.lit(1)) - 1)))
        b, s = ("part", "other") if mine == "blocks" else ("other", "part")
        return spread.select(F.when(F.col(mine).isNull(), F.pmod("pool", F.lit(packs))).otherwise(F.xxhash64("pool", b, s)).alias("key"), "id", "pool", "tokens")

    of = spark.sparkContext.broadcast((of_left, of_right))  # two tables of CELLS numbers

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return block_pairs(a, b, *of.value, k)

    return keyed(lefts, "blocks", "shards").groupBy("key").cogroup(keyed(rights, "shards", "blocks").groupBy("key")).applyInArrow(meet, "q bigint, d bigint, share double, back_share double")


def _power_agrees(a: Column, b: Column) -> Column:
    """How two powers agree.

    3: the same digits, perhaps scaled by thousands, with one dropped or one
    misread; 2: equal up to rounding; 1: close; 0: neither; null if one is missing.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    scaled = F.when(high / low > 500, low * 1000).otherwise(low)
    ratio = high / F.when(scaled > 0, scaled)
    da, db = a.cast("bigint").cast("string"), b.cast("bigint").cast("string")
    longer = F.when(F.length(da) > F.length(db), da).otherwise(db)
    shorter = F.when(F.length(da) > F.length(db), db).otherwise(da)
    dropped = (F.length(longer) == F.length(shorter) + 1) & (F.levenshtein(longer, shorter) == 1)
    misread = (F.length(da) == F.length(db)) & (F.levenshtein(da, db) <= 1)
    cut_off = (F.length(longer) == F.length(shorter) + 3) & longer.startswith(shorter)
    digits = (F.length(shorter) >= 5) & ~shorter.endswith("0000") & (dropped | misread | cut_off)
    return (
        F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0), None).when(digits, 3).when(ratio.between(0.998, 1.002), 2).when(ratio <= 1.06, 1).otherwise(0)
    )


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with names, tags and powers compared exactly: adds alike and letters (0..1, null without a name), agrees, tags and added.

    ``alike`` goes by edits, ``letters`` by the letters in any order.
    ``added``: one name is the other with an ending that second accounts have,
    and the powers are not the same.  Cut names are compared up to the cut.
    """
    side = lambda df, p, key: df.select(F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("skel", "tag", "power")])
    full = pairs.join(side(left, "q", "q"), "q").join(side(right, "d", "d"), "d")
    a, b = F.regexp_replace("q_skel", "…", ""), F.regexp_replace("d_skel", "…", "")
    ca = F.when(F.col("d_skel").endswith("…"), F.substring(a, F.lit(1), F.length(b))).otherwise(a)
    cb = F.when(F.col("q_skel").endswith("…"), F.substring(b, F.lit(1), F.length(a))).otherwise(b)
    alike = 1 - F.levenshtein(ca, cb) / F.greatest(F.length(ca), F.length(cb), F.lit(1))
    whole = ~F.col("q_skel").endswith("…") & ~F.col("d_skel").endswith("…")
    longer = F.when(F.length(a) > F.length(b), a).otherwise(b)
    shorter = F.when(F.length(a) > F.length(b), b).otherwise(a)
    extra = F.when(longer.startswith(shorter), F.substring(longer, F.length(shorter) + 1, F.lit(8)))
    agrees = _power_agrees(F.col("q_power"), F.col("d_power"))
    tags = F.when(F.col("q_tag").isNotNull() & F.col("d_tag").isNotNull(), F.lower("q_tag") == F.lower("d_tag"))
    bag = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    letters = 1 - F.levenshtein(bag(ca), bag(cb)) / F.greatest(F.length(ca), F.length(cb), F.lit(1))
    named = (F.length(a) > 0) & (F.length(b) > 0)
    out = full.withColumn("alike", F.when(named, alike)).withColumn("letters", F.when(named, letters)).withColumn("agrees", agrees).withColumn("tags", tags)
    return out.withColumn("added", whole & F.coalesce(extra.rlike(SECOND_ACCOUNT), F.lit(False)) & (F.coalesce("agrees", F.lit(-1)) < 2))


def _evidence() -> list[Column]:
    """The columns of ``EVIDENCE`` from compared pairs."""
    is_ = lambda c, v: F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
    return [
        F.col("share"), F.col("back_share"), F.col("gap"), F.coalesce("alike", F.lit(0.0)), F.coalesce("letters", F.lit(0.0)), is_("agrees", 3), is_("agrees", 2), is_("agrees", 1), is_("agrees", 0),
        F.coalesce(F.col("tags").cast("double"), F.lit(0.0)), F.coalesce((~F.col("tags")).cast("double"), F.lit(0.0)), (F.col("added") & (F.coalesce("agrees", F.lit(-1)) < 1)).cast("double"), (F.col("added") & (F.coalesce("agrees", F.lit(-1)) == 1)).cast("double"),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (constant last) of a logistic regression by Newton steps, drawn towards ``prior``."""
    a = np.column_stack([x, np.ones(len(x))])
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibration(places: DataFrame, rows: int = CALIBRATION_ROWS) -> np.ndarray:
    """Logistic weights for ``EVIDENCE``.

    Right pairs: mutual first places with the same skeleton or the same power to
    all of at least seven digits, either of which is almost never shared by
    chance.  Wrong pairs: the second places of the same queries, which would have
    come first had the partner been missing.  At most ``rows`` queries take
    part, those with the smallest hashes.
    """
    same_name = (F.col("q_skel") == F.col("d_skel")) & (F.length("q_skel") >= 5)
    same_power = (F.col("q_power") == F.col("d_power")) & (F.col("q_power") >= 1_000_000)
    right = F.col("mutual") & (F.col("place") == 1) & (same_name | same_power) & (F.col("alike") >= 0.3)
    sure = places.where(right).orderBy(F.xxhash64("q"), "q").limit(rows).select("q")
    labelled = places.join(sure, "q", "left_semi").where("place = 1 or place = 2 and coalesce(agrees, 0) < 2").select((F.col("place") == 1).cast("double").alias("y"), *[c.alias(n) for c, n in zip(_evidence(), EVIDENCE, strict=True)])
    got = labelled.toPandas().to_numpy(dtype=float)  # at most two rows a query
    weights = fit_logistic(got[:, 1:], got[:, 0], PRIOR) if len(got) else PRIOR.copy()
    share = (got[:, 0].sum() + 1) / (len(got) + 2)
    bins = places.where("mutual and place = 1 and alike is not null").groupBy(F.round(_logit(weights), 1).alias("x")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # logits lie within a few hundred tenths
    weights[-1] += shifted(bins["x"].to_numpy(dtype=float), bins["n"].to_numpy(dtype=float), share)
    return weights


def _logit(weights: np.ndarray) -> Column:
    sum_ = reduce(lambda s, x: s + x, [float(w) * c for w, c in zip(weights, _evidence(), strict=False)]) + float(weights[-1])
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum_))


def shifted(logits: np.ndarray, counts: np.ndarray, base: float, steps: int = 200) -> float:
    """What to add to the logits so that they suit the share of right pairs among those they are used on.

    The labelled pairs hold right and wrong ones in the share ``base``, mutual
    pairs in another; expectation maximisation over all of them finds it.
    """
    if not counts.sum():
        return 0.0
    odds = np.log(base / (1 - base))
    share = base
    for _ in range(steps):
        shift = np.log(share / (1 - share)) - odds
        after = float(np.sum(counts / (1 + np.exp(-np.clip(logits + shift, -30, 30)))) / counts.sum())
        after = min(max(after, 1e-3), 1 - 1e-3)
        if abs(after - share) < 1e-6:
            break
        share = after
    return float(np.log(share / (1 - share)) - odds)


def match(left: DataFrame, right: DataFrame, least: float = 0.5, block: int = BLOCK_ROWS, near: int = NEAR) -> DataFrame:
    """(left_id, right_id, confidence, alike, agrees) of records about the same thing; both sides as made by :func:`records`.

    A pair comes out if its records are each other's nearest and its calibrated
    confidence reaches ``least``.  The left side may hold a thing several times,
    so left records that have the same nearest record count as one in the test:
    none may stand behind a record that prefers another.  What found no partner
    searches again among the right records that are not taken, until a search
    adds nothing; so a record whose partner stood behind another's is found.

    Every record of the left side comes out at most once; of the right side
    several times if the left side holds it several times.  Defined results:
    records whose scope is null are searched for in all scopes and need close
    powers or an equal tag besides; a null name matches nothing; repeated ids
    count once; empty sides give no rows.  Records that are equal in all
    attributes are searched once; on the right side the smallest id stands for
    them.
    """
    ours, theirs = cut(representatives(left)), cut(representatives(right))
    of_left, of_right = statistics(ours), statistics(theirs)
    pending, untaken, weights, out = ours, theirs, None, None
    by_q, by_d = W.partitionBy("q").orderBy(F.desc("share"), "d"), W.partitionBy("d").orderBy(F.desc("back_share"), "q")
    while True:
        found = nearest(pending, untaken, of_left, of_right, near, block)
        placed = (
            found.withColumn("place", F.row_number().over(by_q)).withColumn("gap", F.col("share") - F.coalesce(F.lead("share").over(by_q), F.lit(0.0)))
            .withColumn("back_place", F.row_number().over(by_d))
            .withColumn("other", F.min(F.when(F.col("place") > 1, F.col("back_place"))).over(W.partitionBy("d")))
            .withColumn("mutual", (F.col("place") == 1) & F.coalesce(F.col("back_place") < F.col("other"), F.lit(True)))
            .where("place <= 2").select("q", "d", "share", "back_share", "gap", "place", "mutual")
        )
        judged = cut(compared(placed, pending, untaken))
        if weights is None:
            weights = calibration(judged)
        confidence = F.round(1 / (1 + F.exp(-_logit(weights))), 6)
        won = cut(
            judged.where("mutual and alike is not null").withColumn("confidence", confidence).where(F.col("confidence") >= least)
            .select("q", "d", "confidence", F.round("alike", 6).alias("alike"), "agrees", "tags")
        )
        if won.isEmpty():
            break
        out = won if out is None else out.unionByName(won)
        pending = cut(pending.join(won.select(F.col("q").alias("id")), "id", "left_anti"))
        untaken = cut(untaken.join(won.select(F.col("d").alias("id")).distinct(), "id", "left_anti"))
    out = won if out is None else out
    free = ours.where("scope is null").select(F.col("id").alias("q")).withColumn("free", F.lit(True))
    out = out.join(free, "q", "left").where("free is null or agrees >= 1 or tags")
    rep = ours.select(F.col("id").alias("q"), *[F.col(c).alias(f"o_{c}") for c in SAME])
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in SAME])
    return left.join(out.join(rep, "q"), on).select(F.col("id").alias("left_id"), F.col("d").alias("right_id"), "confidence", "alike", "agrees")
