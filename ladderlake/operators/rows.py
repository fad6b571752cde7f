"""Row reconstruction: from positioned tokens of a screen to ranked rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ladderlake.functions import text as tx

SCREEN = ["snapshot_id", "source_file"]


def token_geometry(tokens: DataFrame) -> DataFrame:
    """Corners and centre of a token from its box, an array of points."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    corners = tokens.withColumns({"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)})
    return corners.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2}).drop("box")


def token_dedup(tokens: DataFrame, overlap: float = 0.75) -> DataFrame:
    """Of tokens that overlap by ``overlap`` of the smaller area the most confident stays; greedy within one screen.

    A screen holds some dozens of tokens, so a group always fits a task.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "token_id"], ascending=[False, True], kind="stable")
        kept: list[tuple] = []
        rows = []
        for i, t in enumerate(pdf.itertuples(index=False)):
            area = max((t.x2 - t.x1) * (t.y2 - t.y1), 1e-9)
            clash = False
            for x1, y1, x2, y2, other in kept:
                common = max(0.0, min(t.x2, x2) - max(t.x1, x1)) * max(0.0, min(t.y2, y2) - max(t.y1, y1))
                clash = clash or common >= overlap * min(area, other)
            if not clash:
                kept.append((t.x1, t.y1, t.x2, t.y2, area))
                rows.append(i)
        return pdf.iloc[rows]

    return tokens.groupBy(*SCREEN).applyInPandas(keep, tokens.schema)


def y_islands(tokens: DataFrame, tolerance: float = 18.0) -> DataFrame:
    """Text lines as islands: a new line begins where the next centre lies more than ``tolerance`` lower."""
    w = W.partitionBy(*SCREEN).orderBy("cy", "token_id")
    new = F.coalesce((F.col("cy") - F.lag("cy").over(w) > tolerance).cast("int"), F.lit(1))
    return tokens.withColumn("line", F.sum(new).over(w))


def y_clusters(tokens: DataFrame, tolerance: float = 28.0) -> DataFrame:
    """Text lines by nearest running mean, in reading order; greedy within one screen."""

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cy", "token_id"], kind="stable")
        means: list[float] = []
        sizes: list[int] = []
        line = []
        for y in pdf["cy"]:
            best = min(range(len(means)), key=lambda k: abs(means[k] - y), default=-1)
            if best < 0 or abs(means[best] - y) > tolerance:
                means.append(float(y))
                sizes.append(1)
                best = len(means) - 1
            else:
                sizes[best] += 1
                means[best] += (y - means[best]) / sizes[best]
            line.append(best + 1)
        return pdf.assign(line=line)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tokens.schema.fields) + ", line bigint"
    return tokens.groupBy(*SCREEN).applyInPandas(cluster, schema)


def row_anchors(lines: DataFrame) -> DataFrame:
    """The right-most power token of each line, with the band that reaches half-way to its neighbours."""
    powers = lines.where(tx.is_power(F.col("text")))
    anchor = powers.groupBy(*SCREEN, "line").agg(F.max(F.struct("cx", "confidence", "cy", "x2", "text", "token_id")).alias("a")).select(*SCREEN, "line", "a.*")
    w = W.partitionBy(*SCREEN).orderBy("cy", "token_id")
    gap = F.col("cy") - F.lag("cy").over(w)
    height = F.greatest(F.lit(36.0), F.least(F.lit(90.0), F.coalesce(F.percentile("gap", 0.5).over(W.partitionBy(*SCREEN)), F.lit(58.0))))
    sized = anchor.withColumn("gap", gap).withColumn("height", height)
    top = F.coalesce((F.col("cy") + F.lag("cy").over(w)) / 2, F.col("cy") - F.col("height") / 2)
    bottom = F.coalesce((F.col("cy") + F.lead("cy").over(w)) / 2, F.col("cy") + F.col("height") / 2)
    return sized.select(*SCREEN, F.col("line").alias("row_no"), F.col("text").alias("power_text"), "cx", "cy", "x2", top.alias("top"), bottom.alias("bottom"))


def row_bands(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """Tokens of each anchor's band left of the power, in reading order, joined to one raw text."""
    t, a = lines.alias("t"), anchors.alias("a")
    same = (F.col("t.snapshot_id") == F.col("a.snapshot_id")) & (F.col("t.source_file") == F.col("a.source_file"))
    inside = (F.col("t.cy") >= F.col("a.top")) & (F.col("t.cy") < F.col("a.bottom")) & (F.col("t.cx") <= F.col("a.x2") + 20)
    hit = t.join(a, same & inside).select("a.snapshot_id", "a.source_file", "a.row_no", "a.power_text", F.struct("t.cx", "t.text", "t.confidence").alias("w"))
    return hit.groupBy(*SCREEN, "row_no", "power_text").agg(F.array_sort(F.collect_list("w")).alias("words"))  # the words of one line


# A tag in brackets, and one whose opening bracket was lost.
BRACKET_TAG, HALF_TAG = r"\[\s*([A-Za-z0-9]{2,7})\s*\]", r"^\s*[Il1|]?([A-Za-z0-9]{2,6})\s*\]"


def _tag_of(text: Column) -> Column:
    """The tag in a token, a stroke that was glued to a longer one taken off; null without a letter in it."""
    whole = F.regexp_extract(text, BRACKET_TAG, 1)
    found = F.when(whole != "", whole).otherwise(F.regexp_extract(text, HALF_TAG, 1))
    bare = F.when((F.length(found) >= 4) & found.rlike("^[Il1].*[A-Za-z]"), F.substring(found, 2, 6)).otherwise(found)
    return F.when(F.length(bare).between(2, 6) & bare.rlike("[A-Za-z]"), bare)


def is_badge(text: Column) -> Column:
    """Small pieces of decoration that are no names: marks, or a few characters that mix marks, digits and ideographs."""
    count = lambda letters: F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    latin, digits, hangul = count("A-Za-z"), count("0-9"), count("\uac00-\ud7af")
    marks = F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", ""))
    short = F.length(text) <= 8
    other = (short & (marks >= 1) & ((digits >= 1) | (latin <= 1))) | (short & text.rlike(r"[^\x00-\x7f]") & (latin <= 1) & (digits >= 1))
    return (F.length(text) <= 2) & ~text.rlike(r"[\p{L}\p{N}]") | ~((hangul > 0) & (latin == 0) & (marks == 0)) & other


def reconstruct_columns(words: Column) -> Column:
    """Tag, name and whether badges or words before the tag were left out, from the words of a row in reading order.

    The last word with a tag gives the tag; what follows the first one is the
    name.  Without a tag all words but badges are the name; no word gives ''.
    """
    clean = F.filter(F.transform(words, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    tags = F.transform(clean, _tag_of)
    at = F.array_position(F.transform(tags, lambda t: t.isNotNull()), True)
    bare = F.transform(clean, lambda t: F.when(_tag_of(t).isNotNull(), F.trim(F.regexp_replace(F.regexp_replace(t, "^.*?" + BRACKET_TAG, ""), HALF_TAG, ""))).otherwise(t))
    after = F.filter(F.slice(bare, F.greatest(at, F.lit(1)).cast("int"), F.greatest(F.size(bare), F.lit(1))), lambda t: t != "")
    plain = F.filter(clean, lambda t: ~is_badge(t))
    tag = F.try_element_at(F.array_compact(tags), F.lit(-1))
    name = F.when(at > 0, F.array_join(after, " ")).otherwise(F.array_join(plain, " "))
    left_out = F.when(at > 0, at > 1).otherwise(F.size(plain) < F.size(clean))
    return F.struct(tag.alias("tag"), name.alias("name"), left_out.alias("left_out"))


def parse_rows(bands: DataFrame) -> DataFrame:
    """(…, ocr_rank, tag, name, power, raw_text, confidence) of each band."""
    texts = F.transform("words", lambda x: x["text"])
    middle = F.filter(texts, lambda x: ~tx.is_power(x) & ~tx.is_noise(x))
    rank = F.try_element_at(F.filter(middle, lambda x: tx.is_rank(x)), F.lit(1))
    columns = reconstruct_columns(F.filter(middle, lambda x: ~tx.is_rank(x)))
    return bands.select(
        *SCREEN, "row_no", rank.cast("int").alias("ocr_rank"), columns.alias("c"),
        tx.parse_magnitude(F.col("power_text")).alias("power"), F.array_join(texts, " ").alias("raw_text"), F.array_min(F.transform("words", lambda x: x["confidence"])).alias("confidence"),
    ).select(*SCREEN, "row_no", "ocr_rank", "c.tag", "c.name", "power", "raw_text", "confidence")


def dedupe_identity_power(rows: DataFrame, keys: list[str], name: str, power: str, order: str, tolerance: float = 0.003) -> DataFrame:
    """Rows of one name whose powers follow within ``tolerance`` become one: the greatest power, the number of rows."""
    w = W.partitionBy(*keys, name).orderBy(F.desc(power), order)
    new = F.coalesce((F.lag(power).over(w) - F.col(power) > tolerance * F.lag(power).over(w)).cast("int"), F.lit(1))
    island = rows.withColumn("island", F.sum(new).over(w))
    return island.groupBy(*keys, name, "island").agg(F.max(power).alias(power), F.count("*").alias("merged")).drop("island")
