"""Mixing sources to target weights.

Every document of a source gets the same expected number of copies.  Its
integral part is certain; the fractions are decided by pivotal rounding: two
documents meet, and tokens' worth of probability moves from one to the other in
a direction drawn at random so that neither's expectation changes, until one of
the two is integral.  The token sum of the pair never changes, so the sum of a
source is met up to one document.  Blocks of documents are rounded in parallel;
the one undecided document of each goes up a reduction tree.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlake.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenization pattern of this byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, FAN_IN = 50_000, 64


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens), one row per doc_id; null and empty texts have no tokens.

    Only counts leave the tasks; the texts are never shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    counted = documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max("source").alias("source"), F.max("tokens").alias("tokens"))


def pivotal(weight: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round ``p`` in [0, 1] so that sum(weight * p) stays; returns the rounded values and the index left undecided, or -1.

    All undecided neighbours meet in pairs at once; each pair decides one of its
    two, and the others meet in the next round, about log2(n) rounds in all.
    """
    out = p.astype(float).copy()
    empty = weight <= 0
    out[empty] = rng.random(int(empty.sum())) < out[empty]
    undecided = np.flatnonzero(~empty & (out > 1e-12) & (out < 1 - 1e-12))
    decided = ~empty
    decided[undecided] = False
    out[decided] = np.round(out[decided])
    while len(undecided) > 1:
        even = len(undecided) // 2 * 2
        i, j, rest = undecided[0:even:2], undecided[1:even:2], undecided[even:]
        a, b, wa, wb = out[i], out[j], weight[i], weight[j]
        up, down = np.minimum((1 - a) * wa, b * wb), np.minimum((1 - b) * wb, a * wa)
        take = rng.random(len(i)) * (up + down) < down
        a, b = np.where(take, a + up / wa, a - down / wa), np.where(take, b - up / wb, b + down / wb)
        a_open, b_open = (a > 1e-9) & (a < 1 - 1e-9), (b > 1e-9) & (b < 1 - 1e-9)
        out[i], out[j] = np.where(a_open, a, np.round(a)), np.where(b_open & ~a_open, b, np.round(b))
        undecided = np.concatenate([np.where(a_open, i, j)[a_open | b_open], rest])
    return out, int(undecided[0]) if len(undecided) else -1


def plan_rates(available: dict[str, int], targets: list[tuple[str, float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies per document of each source.

    Without ``total_tokens`` the mix is as large as it can be with every share
    met: the source that reaches its repeats first sets the size.  With a total
    beyond that, sources at their repeats fall short and the others keep their
    share of the total.
    """
    usable = [(s, share, cap) for s, share, cap in targets if share and share > 0 and cap and cap > 0 and available.get(s, 0) > 0]
    if not usable:
        return {}
    whole = sum(share for _, share, _ in usable)
    if total_tokens is None:
        total_tokens = min(available[s] * cap * whole / share for s, share, cap in usable)
    return {s: min(float(cap), share / whole * total_tokens / available[s]) for s, share, cap in usable}


def _rounded(pdf: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """One block of one source; at most one row stays undecided."""
    pdf = pdf.sort_values(["tokens", "doc_id"], kind="stable")
    rng = np.random.default_rng([seed, level, abs(hash(int(pdf["doc_id"].iloc[0]))) % (1 << 31), len(pdf)])
    p, held = pivotal(pdf["tokens"].to_numpy(dtype=float), pdf["p"].to_numpy(), rng)
    undecided = np.zeros(len(pdf), dtype=bool)
    if held >= 0:
        undecided[held] = True
    return pdf.assign(p=p, undecided=undecided)


def _block_rounder(seed: int, level: int):
    return lambda pdf: _rounded(pdf, seed, level)


def mix_sources(
    counts: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, block: int = BLOCK, fan_in: int = FAN_IN
) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document of a target source; copies may be 0.

    ``counts`` as of :func:`token_counts`; ``targets``: source, target_share,
    max_repeats, a list that the driver reads (one row per source of the mix).
    Defined results: a source without documents or share adds nothing and the
    others keep their proportions; documents of a null or unlisted source are
    not drawn and do not come out; of a source listed twice the larger share
    counts; documents without tokens are drawn independently.  The draw depends
    on ``seed`` and the ids only.
    """
    listed = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").where("source is not null")
    # one row per source of the mix
    target_rows = [(r["source"], r["target_share"], r["max_repeats"]) for r in listed.collect()]
    names = [s for s, _, _ in target_rows]
    held = cut(counts.where(F.col("source").isin(names)).select("doc_id", "source", "tokens"))
    sums = {r["source"]: (r["t"], r["n"]) for r in held.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    rates = plan_rates({s: t for s, (t, _) in sums.items()}, target_rows, total_tokens)
    caps = {s: c for s, _, c in target_rows}
    pairs = [x for s in names for x in (F.lit(s), F.lit(float(rates.get(s, 0.0))))]
    cap_pairs = [x for s in names for x in (F.lit(s), F.lit(int(caps[s] or 0)))]
    if not pairs:
        return held.select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    rate = F.element_at(F.create_map(*pairs), F.col("source"))
    base = F.least(F.floor(rate), F.element_at(F.create_map(*cap_pairs), F.col("source"))).cast("int")
    most = max([n for _, n in sums.values()], default=0)
    blocks = max(1, math.ceil(most / block))
    rows = held.withColumns({"base": base, "p": F.greatest(rate - F.floor(rate), F.lit(0.0)), "block": F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks))})
    schema = "doc_id bigint, source string, tokens bigint, base int, p double, block bigint, undecided boolean"
    decided: list[DataFrame] = []
    level = 0
    while True:
        out = cut(rows.groupBy("source", "block").applyInPandas(_block_rounder(seed, level), schema))
        decided.append(out.where("not undecided"))
        rows = out.where("undecided").drop("undecided").withColumn("block", F.floor(F.col("block") / fan_in))
        if blocks == 1:
            break
        blocks = max(1, math.ceil(blocks / fan_in))
        level += 1
    # the last document of each source is drawn with the probability it is left with
    coin = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    decided.append(rows.withColumn("p", F.when(coin < F.col("p"), 1.0).otherwise(0.0)).withColumn("undecided", F.lit(False)))
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    return every.select("doc_id", "source", "tokens", (F.col("base") + F.round("p").cast("int")).alias("copies"))


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, tokens and copies drawn, target and reached share of all drawn tokens, most copies of one document."""
    drawn = mix.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum(F.col("copies").cast("bigint")).alias("copies"),
        F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"),
    )
    listed = targets.groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    total = drawn.agg(F.sum("drawn_tokens").alias("total"))
    zero = F.lit(0).cast("bigint")
    return (
        listed.join(drawn, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select(
            "source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("available_tokens", zero).alias("available_tokens"),
            F.coalesce("copies", zero).alias("copies"), F.coalesce("drawn_tokens", zero).alias("drawn_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.round(F.coalesce(F.col("drawn_tokens"), zero) / F.nullif("total", F.lit(0)), 6).alias("reached_share"),
        )
    )
