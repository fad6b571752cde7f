"""Visually identical text with different characters.

A text is decomposed, its ignorable characters are deleted and its blanks made
one kind.  Every remaining character then opens the set of characters that look
like it, one per script, and a few open two such sets; these sets form a
lattice.  Viterbi takes the path that stays in one script as far as it can and,
among such paths, the one with the best character bigrams.  Where every
character opens one set, two texts get the same path exactly if they read
alike; which letter an ambiguous character stands for is the path's decision.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like the Latin letter they stand under, by script.
LOOKALIKES: dict[str, tuple[str, str]] = {
    "CYRILLIC": ("aceopxyisjhdvqwlABCEHIJKMOPSTXYGVQW", "асеорхуіѕјһԁѵԛԝӏАВСЕНІЈКМОРЅТХУԌѴԚԜ"),
    "GREEK": ("oavcipuyjABEFHIKMNOPTXYZC", "οανϲιρυγϳΑΒΕϜΗΙΚΜΝΟΡΤΧΥΖϹ"),
    "ARMENIAN": ("uonghqjUOS", "սօոցհզյՍՕՏ"),
    "CHEROKEE": ("RDTAJWMHGZVSLCPKBE", "ᎡᎠᎢᎪᎫᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴᎬ"),
    "COPTIC": ("pocOPCMNKHTX", "ⲣⲟⲥⲞⲢⲤⲘⲚⲔⲎⲦⲬ"),
    "IPA": ("ag", "ɑɡ"),
    "LISU": ("BPDTGKJCZFMNLSRVHWXYAEOU", "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓳꓴ"),
}
# Letters of other scripts that read as either of two Latin letters; the path through the lattice decides.
AMBIGUOUS = {"Ӏ": "Il", "ꓲ": "Il", "ⵏ": "Il", "ⵔ": "Oo", "ⲓ": "Il"}
# Katakana and the ideographs that look like them.
KANA_IDEOGRAPHS = ("ロカトタエニハオ", "口力卜夕工二八才")
#: Compatibility forms that are a matter of width or typesetting; raised, circled and similar forms look different and stay.
PLAIN_FORMS = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Characters without a visible form that are no format characters by category.
INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

SWITCH, MIXED, MEMO = 6.0, 0.2, 200_000


def _classes() -> tuple[dict[str, int], dict[int, dict[str, str]]]:
    """Character to class, and class to its characters by script."""
    of: dict[str, int] = {}
    members: dict[int, dict[str, str]] = {}
    for script, (latin, other) in LOOKALIKES.items():
        for a, b in zip(latin, other, strict=True):
            of[a] = of[b] = ord(a)
            members.setdefault(ord(a), {"LATIN": a})[script] = b
    for a, b in zip(*KANA_IDEOGRAPHS, strict=True):
        of[a] = of[b] = ord(a)
        members[ord(a)] = {"KATAKANA": a, "CJK": b}
    return of, members


CLASS_OF, MEMBERS = _classes()


def _script(ch: str) -> str:
    """Coarse script of a letter; '' for everything that goes with any script."""
    if ch in CLASS_OF:
        return next(s for s, c in MEMBERS[CLASS_OF[ch]].items() if c == ch)
    if not ch.isalpha():
        return ""
    return unicodedata.name(ch, "").split(" ")[0]


def compatible(text: str) -> str:
    """Decomposed text without ignorable characters, one kind of blank, none at the ends, plain compatibility forms."""
    out = []
    for ch in text:
        o = ord(ch)
        cat = unicodedata.category(ch)
        if cat == "Cf" or o in INVISIBLE:
            continue
        if cat == "Zs" or ch in "\t\n\r\v\f":
            out.append(" ")
            continue
        d = unicodedata.decomposition(ch)
        if d.startswith("<") and ch not in CLASS_OF:
            out.append(unicodedata.normalize("NFKC", ch) if d.split(" ")[0] in PLAIN_FORMS else ch)
        else:
            out.append(ch)
    return unicodedata.normalize("NFD", "".join(out)).strip(" ")


def _cell(ch: str) -> list[tuple[str, str]]:
    """(script, character) of everything that looks like ``ch``; characters that read as two letters open the classes of both."""
    if ch in CLASS_OF:
        return list(MEMBERS[CLASS_OF[ch]].items())
    if ch in AMBIGUOUS:
        return [x for latin in AMBIGUOUS[ch] for x in MEMBERS[CLASS_OF[latin]].items()]
    return [(_script(ch), ch)]


def best_reading(chars: str, bigrams: Mapping[str, float]) -> str:
    """The Viterbi path through the lattice of ``chars`` (decomposed text).

    A path pays for every change of script and gains by the frequency of its
    character pairs; pairs of a small and a capital letter inside a word cost.
    """
    lattice = [_cell(c) for c in chars]
    simple = [[c for s, c in cell if s in ("LATIN", "")] for cell in lattice]
    if all(len(x) == 1 for x in simple):
        return "".join(x[0] for x in simple)
    # state: script of the last letter and the letter itself; neutral characters hand the script on
    best: dict[tuple[str, str], tuple[float, str]] = {("", ""): (0.0, "")}
    for cell in lattice:
        step: dict[tuple[str, str], tuple[float, str]] = {}
        for script, ch in cell:
            for (last, before), (score, path) in best.items():
                now = (script or last, ch)
                value = score - (SWITCH if script and last and script != last else 0.0)
                value += bigrams.get(before + ch, 0.0) / 16 - (0.01 if script not in ("", "LATIN") else 0.0)
                value -= MIXED if before.isalpha() and before.islower() and ch.isupper() or before.isupper() and len(path) == 1 and ch.isupper() else 0.0
                kept = step.get(now)
                if kept is None or (value, path + ch) > kept:
                    step[now] = (value, path + ch)
        best = step
    return max(best.values())[1]


def canonical(text: str | None, bigrams: Mapping[str, float] | None = None) -> str | None:
    """One form for all texts that read like ``text``; null stays null and a text without visible characters becomes ''."""
    if text is None:
        return None
    if text.isascii() and text.isprintable():
        return text.strip(" ")
    return unicodedata.normalize("NFC", best_reading(compatible(text), bigrams or {}))


def train_bigrams(names: DataFrame, column: str) -> dict[str, float]:
    """Log counts of the character pairs of all names that hold a look-alike letter.

    The pairs are counted in Spark over all rows.  Both characters must belong
    to a look-alike class, so the driver gets at most the square of their
    number, whatever the data.
    """
    letters = sorted(CLASS_OF)
    text = names.where(F.col(column).isNotNull()).select(F.col(column).alias("t"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, 2)))
    pattern = "^[" + "".join(letters) + "]{2}$"
    counted = text.select(pair.alias("pair")).where(F.col("pair").rlike(pattern)).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return {r["pair"]: math.log1p(r["n"]) for r in counted.collect()}


def canonical_column(column: Column, bigrams: Mapping[str, float]) -> Column:
    """Arrow UDF for :func:`canonical`; repeated names cost one look-up."""

    @F.pandas_udf(T.StringType())
    def run(names: pd.Series) -> pd.Series:
        memo: dict[str, str] = {}
        out = []
        for t in names:
            if t is None:
                out.append(None)
                continue
            c = memo.get(t)
            if c is None:
                if len(memo) > MEMO:
                    memo.clear()
                c = memo[t] = canonical(t, bigrams)
            out.append(c)
        return pd.Series(out, dtype=object)

    # printable ASCII never leaves the JVM
    return F.when(column.rlike("^[\\x20-\\x7e]*$"), F.trim(column)).otherwise(run(column))


def lookalike_pairs(entities: DataFrame, rows: DataFrame, bigrams: Mapping[str, float], salts: int = 8) -> DataFrame:
    """Pairs of records whose names read the same but differ in a character.

    ``entities``: id, kind, name; ``rows``: row_id, kind, name.  Returns
    distinct (table_name, low_id, high_id): pairs of entities of one kind,
    smaller id first, and pairs of an entity and a row.  Null names, and names
    without any visible character, match nothing; rows that repeat an id count
    once; further columns are ignored; empty inputs give no rows.

    Names are brought to their form once each, whatever the number of rows that
    have them, and meet the entities as names; only rows whose name has such a
    partner are attached to the pairs.  That join is salted by row, as one name
    may hold a third of all rows.
    """
    e = entities.select(F.col("id").alias("low_id"), "kind", F.col("name").alias("raw")).distinct()
    e = e.withColumn("form", canonical_column(F.col("raw"), bigrams)).where("form <> ''")
    r = rows.select(F.col("row_id").alias("high_id"), "kind", F.col("name").alias("raw2")).where("kind is not null and raw2 is not null")
    names = r.select("kind", "raw2").distinct().withColumn("form", canonical_column(F.col("raw2"), bigrams)).where("form <> ''")
    hits = names.join(e, ["kind", "form"]).where("raw <> raw2").select("kind", "raw2", "low_id")
    spread = hits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    with_rows = r.withColumn("salt", F.pmod(F.xxhash64("high_id"), F.lit(salts)).cast("int")).join(spread, ["kind", "raw2", "salt"]).select("low_id", "high_id")
    other = e.select("kind", "form", F.col("low_id").alias("high_id"), F.col("raw").alias("raw2"))
    odd = e.where("raw <> form")
    pairs = odd.join(other, ["kind", "form"]).where("raw <> raw2 and low_id <> high_id")
    among = pairs.select(F.least("low_id", "high_id").alias("low_id"), F.greatest("low_id", "high_id").alias("high_id"))
    return (
        among.select(F.lit("entities").alias("table_name"), "low_id", "high_id")
        .unionByName(with_rows.select(F.lit("ranking_rows").alias("table_name"), "low_id", "high_id"))
        .distinct()
    )
