"""Evaluation texts leaking into training text.

Test items are short and documents long, so whole-text MinHash would drown an
item in its document.  Items and documents are therefore sketched by passage:
the MinHash of a passage is the smallest hash of its shingles, and two equal
passages have the same one.  Items are partitioned by size.  Of an item of
``n`` words with ``k`` changed, one of ``k + 1`` pieces stays whole; items of
up to ``SURE_WORDS`` words have passages no longer than that piece, so that no
leak of theirs is missed, and longer ones, which have many passages, longer
passages.  Every run of ``RUN`` words is a sketch by itself.  Only sketches that a filter over all items' sketches lets pass leave
the scan of the documents; what shares enough of them with an item is verified
on the words themselves: either ``RUN`` successive words are equal, or the
item's shingles are contained as far as the changed words leave them and all
but one word in eight is there in order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderlake.llm.textforms import plain_words
from ladderlake.session import cut

RUN = 12
#: "About one word in eight" changed or left out: 1/8 and the spread of that share in an item of a hundred words.
CHANGED = 0.175
#: Size partitions: items from so many words on have shingles of so many words and passages of so many shingles.
SURE_WORDS = 47
SIZES = ((96, 5, 8), (SURE_WORDS + 1, 4, 4))
#: Bits of the filter for every sketch of an item, and its largest size (32 MB); a fuller filter only lets more pass.
FILTER_BITS, FILTER_MOST = 24, 1 << 28
#: Items verified against a document at a time, and characters of text that are sketched at a time.
ITEM_CHUNK, BATCH_CHARS = 256, 8_000_000
#: Numbers of documents with a candidate that are sent to every task at most, to read the documents again without moving them.
BROADCAST_DOCS = 1_000_000
PROBES = 6
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word to a 64-bit number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word) | 1
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """63-bit hash of the shingle that starts at each word; the largest number where it has a gap (0) or no room."""
    n = len(ids)
    out = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    if n < length:
        return out
    m = n - length + 1
    h = np.zeros(m, dtype=np.uint64)
    known = np.ones(m, dtype=bool)
    for k in range(length):
        part = ids[k : k + m]
        known &= part > 0
        h = h * _MIX + part
    out[:m][known] = _mixed(h)[known] >> np.uint64(1)
    return out


def passage_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """MinHash of every passage of ``width`` shingles, by the place it starts at."""
    out = hashes.copy()
    done = 1
    while done < width:
        step = min(done, width - done)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = where.get(y, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def changes(words: int) -> int:
    """Words of an item that may be changed or left out."""
    return int(CHANGED * words)


def size_class(words: int) -> tuple[int, int]:
    """Words of a shingle and shingles of a passage for an item of so many words."""
    for least, length, width in SIZES:
        if words >= least:
            return length, width
    k = changes(words)
    return max(1, min(4, -(-(words - k) // (k + 1)))), 1


def _sketches(ids: np.ndarray, length: int, width: int) -> np.ndarray:
    """Distinct passage MinHashes, marked by size partition."""
    minima = passage_minima(shingle_hashes(ids, length), width)
    minima = np.unique(minima[minima <= np.uint64((1 << 63) - 1)])
    return (minima ^ np.uint64(length * 1_000_003 + width * 7_919)).astype(np.int64)


def least_shared(ids: np.ndarray) -> int:
    """Distinct passage sketches that a document with the whole item shares.

    With passages of one shingle this is exact, as a change takes away a
    shingle's length of them at most.  Of the longer passages of longer items,
    two or three are asked for: of the 15 to 30 that these have, six in eight
    changed words leave far more.
    """
    length, width = size_class(len(ids))
    if width > 1:
        return 2 if width < 8 else 3
    return max(1, len(np.unique(shingle_hashes(ids, length)[: len(ids) - length + 1])) - length * changes(len(ids)))


def item_sketches(items: DataFrame) -> DataFrame:
    """(h, i, v, weight, need, length, width) of items (i, v, t): passage MinHashes, and every run of ``RUN`` words, which suffices by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Words()
        for pdf in batches:
            parts = []
            for i, v, t in zip(pdf["i"], pdf["v"], pdf["t"], strict=True):
                ids = np.array([numbers[w] for w in plain_words(t)], dtype=np.uint64)
                if len(ids):
                    need = least_shared(ids)
                    for (length, width), weight in ((size_class(len(ids)), 1), ((RUN, 1), need)):
                        parts.append(pd.DataFrame({"h": _sketches(ids, length, width), "i": i, "v": v, "weight": weight, "need": need, "length": length, "width": width}))
            if parts:
                yield pd.concat(parts)

    return items.mapInPandas(run, "h bigint, i bigint, v bigint, weight int, need int, length int, width int")


def sketch_filter(sketches: DataFrame, count: int) -> np.ndarray:
    """Bytes of a Bloom filter over all sketches, put together where they are; at most ``FILTER_MOST`` bits reach the driver."""
    bits = min(FILTER_MOST, max(1 << 16, 1 << (FILTER_BITS * count - 1).bit_length()))
    step = F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1).cast("bigint"))
    places = sketches.select(F.explode(F.array(*[(F.col("h").bitwiseAND(F.lit(bits - 1)) + step * j).bitwiseAND(F.lit(bits - 1)) for j in range(PROBES)])).alias("p"))
    one = F.expr("shiftleft(1L, cast(p & 31 as int))")
    rows = places.groupBy(F.shiftright("p", 5).alias("at")).agg(F.bit_or(one).alias("set")).toArrow()
    filled = np.zeros(bits // 32, dtype="<u4")
    filled[rows["at"].to_numpy()] = rows["set"].to_numpy().astype(np.uint32)
    return filled


def _passes(h: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which sketches may be in the filter: their ``PROBES`` places are all set."""
    mask = np.uint64(len(filled) * 32 - 1)
    x = h.astype(np.uint64)
    step, at, out = (x >> np.uint64(32)) | np.uint64(1), x & mask, np.arange(len(h))
    for _ in range(PROBES):
        place = at[out]
        out = out[(filled[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1]
        at = (at + step) & mask
    passed = np.zeros(len(h), dtype=bool)
    passed[out] = True
    return passed


def document_hits(documents: DataFrame, filled: np.ndarray, sizes: list[tuple[int, int]]) -> DataFrame:
    """(d, h): sketches of documents (d, t) that the filter lets pass; each text by itself, nothing else leaves the tasks."""
    shared = documents.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, bits = _Words(), shared.value
        for pdf in batches:
            docs, texts = pdf["d"].to_numpy(), pdf["t"].tolist()
            first = size = 0
            for k in range(len(texts) + 1):
                if k == len(texts) or size > BATCH_CHARS:
                    yield from hits(docs[first:k], texts[first:k], numbers, bits)
                    first, size = k, 0
                if k < len(texts):
                    size += len(texts[k])

    def hits(docs: np.ndarray, texts: list[str], numbers: _Words, bits: np.ndarray) -> Iterator[pd.DataFrame]:
        flat: list[int] = []
        lengths = []
        for t in texts:
            words = plain_words(t)
            flat.extend([numbers[w] for w in words])
            flat.extend([0] * RUN)
            lengths.append(len(words) + RUN)
        ids, doc = np.array(flat, dtype=np.uint64), np.repeat(np.arange(len(docs)), lengths)
        for length, width in sizes:
            minima = passage_minima(shingle_hashes(ids, length), width)
            ok = minima <= np.uint64((1 << 63) - 1)
            h = (minima ^ np.uint64(length * 1_000_003 + width * 7_919)).astype(np.int64)
            ok[ok] = _passes(h[ok], bits)
            if ok.any():
                yield pd.DataFrame({"d": docs[doc[ok]], "h": h[ok]}).drop_duplicates()

    return documents.mapInPandas(run, "d bigint, h bigint")


def holds(words: np.ndarray, target: np.ndarray) -> bool:
    """Whether the words of a document hold ``RUN`` successive words of an item, or the item with few enough changed or left out."""
    n = len(target)
    if n >= RUN and len(words) >= RUN:
        runs, own = shingle_hashes(words, RUN)[: len(words) - RUN + 1], shingle_hashes(target, RUN)[: n - RUN + 1]
        at = np.flatnonzero(np.isin(runs, own))
        if len(at):
            exact = {target[k : k + RUN].tobytes() for k in range(n - RUN + 1)}
            if any(words[k : k + RUN].tobytes() in exact for k in at.tolist()):
                return True
    k, length = changes(n), size_class(n)[0]
    if len(words) < n - k or len(words) < length or n < length:
        return False
    theirs, own = shingle_hashes(words, length)[: len(words) - length + 1], shingle_hashes(target, length)[: n - length + 1]
    at = np.flatnonzero(np.isin(theirs, own))
    # each change takes ``length`` shingles at most
    need = max(1, len(np.unique(own)) - length * k)
    if len(np.unique(theirs[at])) < need:
        return False
    order = np.argsort(own, kind="stable")
    lo, hi = np.searchsorted(own[order], theirs[at], "left"), np.searchsorted(own[order], theirs[at], "right")
    shifts = np.sort(np.concatenate([a - order[x:y] for a, x, y in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)]))
    # shingles of one place lie within ``k`` shifts: every place with enough of them is compared
    reach, wanted = max(k, 8), target.tolist()
    x = 0
    while x < len(shifts):
        start = int(shifts[x])
        near = int(np.searchsorted(shifts, start + 2 * reach, side="right"))
        if near - x >= need:
            slack = max(2, n // 6)
            stretch = words[max(0, start - slack) : start + 2 * reach + n + slack]
            if common_in_order(wanted, stretch.tolist()) >= n - k:
                return True
        x = max(x + 1, int(np.searchsorted(shifts, start + reach, side="right")))
    return False


def _verified(pairs: DataFrame) -> DataFrame:
    """Of rows (d, t, items: list of (i, t)) those (i, d) whose text holds the item."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Words()
        for pdf in batches:
            out = []
            for d, t, items in zip(pdf["d"], pdf["t"], pdf["items"], strict=True):
                words = np.array([numbers[w] for w in plain_words(t)], dtype=np.uint64)
                for item in items:
                    if holds(words, np.array([numbers[w] for w in plain_words(item["t"])], dtype=np.uint64)):
                        out.append((item["i"], d))
            if out:
                yield pd.DataFrame(out, columns=["i", "d"])

    return pairs.mapInPandas(run, "i bigint, d bigint")


def find_leaks(
    items: DataFrame,
    documents: DataFrame,
    item_id: str = "item_id",
    item_text: str = "item_text",
    doc_id: str = "doc_id",
    text: str = "text",
    chunk: int = ITEM_CHUNK,
) -> DataFrame:
    """Distinct (item_id, doc_id) of all documents that hold ``RUN`` successive words or most of an item.

    Documents are sketched in one scan whatever the number of items, and only
    sketches that pass the filter are shuffled.  Documents with a candidate are
    read once more and verified against at most about ``chunk`` items a row.
    Defined results: null and empty texts, and items without a word, leak
    nothing; an item of fewer than ``RUN`` words leaks as a whole only; copies
    of a document and of an item are all reported; further columns are ignored;
    empty inputs give no rows.
    """
    source = items.select(F.col(f"`{item_id}`").cast("bigint").alias("i"), F.col(f"`{item_text}`").alias("t")).where("i is not null and t is not null").distinct().withColumn("v", F.xxhash64("t"))
    docs = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("d"), F.col(f"`{text}`").alias("t")).where("t is not null and d is not null")
    sketches = cut(item_sketches(source.select("i", "v", "t")))
    sizes = sketches.groupBy("length", "width").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each size partition
    filled = sketch_filter(sketches, max(1, sum(r["n"] for r in sizes)))
    hits = document_hits(docs, filled, [(r["length"], r["width"]) for r in sizes]).distinct()
    shared = hits.join(sketches.select("h", "i", "v", "weight", "need"), "h").groupBy("d", "i", "v", "need").agg(F.sum("weight").alias("n"))
    candidates = cut(shared.where("n >= need").select("d", "i", "v"))
    found = candidates.select("d").distinct()
    few = found.count() <= BROADCAST_DOCS
    many = candidates.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts"))
    with_text = candidates.join(source, ["i", "v"]).join(many, "d").select("d", F.pmod(F.xxhash64("i", "v"), "parts").alias("part"), F.struct("i", "t").alias("item"))
    chunks = with_text.groupBy("d", "part").agg(F.collect_list("item").alias("items")).select("d", "items")
    docs = docs.join(F.broadcast(found) if few else found, "d", "left_semi")  # beyond the bound by shuffle
    return _verified(docs.join(chunks, "d").select("d", "t", "items")).distinct().select(F.col("i").alias(item_id), F.col("d").alias(doc_id))
