"""Text and number forms: parsing, normal forms, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOISE_WORDS = ("warzone", "server", "rank", "alliance", "power", "ranking", "commander")


def parse_magnitude(c: Column) -> Column:
    """'12.5m', '1,234', '2b' as BIGINT: separators are dropped first, then b, m and k scale; anything else is null."""
    text = F.regexp_replace(F.lower(F.trim(c)), "[., ]", "")
    number = F.regexp_extract(text, "^([0-9]+)([bmk]?)$", 1)
    unit = F.regexp_extract(text, "^([0-9]+)([bmk]?)$", 2)
    scale = F.when(unit == "b", 1_000_000_000).when(unit == "m", 1_000_000).when(unit == "k", 1_000).otherwise(1)
    return F.when(number != "", number.cast("bigint") * scale.cast("bigint"))


def parse_server(c: Column) -> Column:
    n = F.regexp_extract(c, "([0-9]{1,5})", 1)
    value = F.when(n != "", n.cast("int"))
    return F.when(value.between(1, 9999), value)


def split_tag(c: Column) -> Column:
    """'[TAG] name' or 'TAG name' as a struct; a bare first word is the tag."""
    pattern = r"^\[?([A-Za-z0-9]+)\]?\s*(.*)$"
    return F.struct(F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).alias("tag"), F.regexp_extract(c, pattern, 2).alias("name"))


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def is_noise(c: Column) -> Column:
    low = F.lower(F.trim(c))
    found = low == ""
    for word in NOISE_WORDS:
        found = found | (low == word)
    return found


def is_power(c: Column) -> Column:
    return F.regexp_replace(c, "[., ]", "").rlike("^[0-9]{6,12}$")


def is_rank(c: Column) -> Column:
    return c.rlike("^[0-9]{1,3}$")


def compare_power(expected: Column, actual: Column) -> Column:
    """Match type of a read power: exact, near, a dropped last or inner digit, mismatch, missing."""
    a, b = expected.cast("string"), actual.cast("string")
    rel = F.abs(expected - actual) / F.when(expected != 0, F.abs(expected))
    dropped_last = F.abs(expected - actual * 10) / F.when(expected != 0, F.abs(expected)) <= 0.005
    inserts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: F.concat(F.substring(b, F.lit(1), i), F.lit("0"), F.substring(b, i + 1, F.lit(20)))
    )
    zero = F.length(b).between(7, 8) & F.array_contains(inserts, a)
    return (
        F.when(expected.isNull() | actual.isNull(), "missing").when(expected == actual, "exact").when(rel <= 1e-5, "near").when(zero, "insert_zero")
        .when(dropped_last, "scale_x10_truncated_digit").otherwise("mismatch")
    )


#: Width of the logarithmic buckets of powers: a little above a relative difference of 0.005.
REPAIR_WIDTH = 0.006


def power_repairs(power: Column) -> Column:
    """What a power of 7 or 8 digits may have been: ten times it, or with a zero put into each gap; empty for others."""
    digits = power.cast("string")
    whole = lambda i: F.when(i == 0, power * 10).otherwise(F.concat(F.substring(digits, F.lit(1), i), F.lit("0"), F.substring(digits, i + 1, F.lit(20))).cast("bigint"))
    return F.when(F.length(digits).between(7, 8), F.transform(F.sequence(F.lit(0), F.length(digits) - 1), whole)).otherwise(F.array().cast("array<bigint>"))


def power_evidence(expected: Column, actual: Column, near: float) -> Column:
    """(kind, similarity) of two positive powers: exact, near, or the closest repair within 0.005, the first of equals; else null."""
    off = lambda c: F.abs(expected - c) / F.greatest(expected, c)
    best = F.array_min(F.transform(power_repairs(actual), lambda c, i: F.struct(off(c).alias("d"), i.alias("i"))))
    found = lambda kind, similarity: F.struct(kind.alias("kind"), similarity.alias("similarity"))
    return (
        F.when(expected == actual, found(F.lit("exact"), F.lit(1.0))).when(off(actual) <= near, found(F.lit("near"), 1 - off(actual)))
        .when(best["d"] <= 0.005, found(F.when(best["i"] == 0, "scale_x10_truncated_digit").otherwise("insert_zero"), 1 - best["d"]))
    )


def name_category(c: Column) -> Column:
    """Scripts of a name: one of them alone, or a mixture with Latin letters."""
    has = {s: F.coalesce(c.rlike(p), F.lit(False)) for s, p in (("latin", "[A-Za-zÀ-ɏ]"), ("hangul", "[가-힣]"), ("kana", "[぀-ヿ]"), ("cjk", "[一-鿿]"), ("cyrillic", "[Ѐ-ӿ]"))}
    east = has["hangul"] | has["kana"] | has["cjk"]
    return (
        F.when(has["latin"] & east, "mixed_latin_cjk").when(has["latin"] & has["cyrillic"], "mixed_latin_cyrillic").when(has["hangul"], "hangul_only").when(has["kana"] | has["cjk"], "cjk_only")
        .when(has["cyrillic"], "cyrillic_only").when(has["latin"], "latin_only").otherwise("symbols")
    )


@F.pandas_udf(T.StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def casefold(names: pd.Series) -> pd.Series:
    return names.map(lambda s: None if s is None else s.casefold())


@F.pandas_udf(T.StringType())
def identity_key(names: pd.Series) -> pd.Series:
    """Letters and digits without case and accents."""

    def key(s: str | None) -> str | None:
        if s is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if c.isalnum() and not unicodedata.combining(c))

    return names.map(key)


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity; two empty texts are equal, one empty is unlike."""
    a, b = a or "", b or ""
    if not a and not b:
        return 1.0
    return SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(similarity(x, y), 4) for x, y in zip(a, b, strict=True)])


def kept_digits(old: str | None, new: str | None) -> float:
    """How far a repaired number keeps the digits that were read: common ends and the common subsequence."""
    if not old or not new:
        return 0.0
    n = min(len(old), len(new))
    head = next((i for i in range(n) if old[i] != new[i]), n)
    tail = next((i for i in range(n) if old[-1 - i] != new[-1 - i]), n)
    row = [0] * (len(new) + 1)
    for x in old:
        last = 0
        for j, y in enumerate(new, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return round(min(1.0, (0.48 * head + 0.32 * tail + 0.20 * row[-1]) / max(len(old), 1)), 4)


@F.pandas_udf(T.DoubleType())
def digit_preservation(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([kept_digits(a, b) for a, b in zip(old, new, strict=True)])


def aligned(a: str, b: str) -> list[tuple[str, str, str]]:
    """Character alignment (operation, expected, seen) by edit distance."""
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            out += [("MATCH", x, x) for x in a[i:j]]
            continue
        left, right = a[i:j], b[k:m]
        for n in range(max(len(left), len(right))):
            x, y = left[n : n + 1], right[n : n + 1]
            kind = "SEPARATOR_GAP" if (x or y) in " _-." and not (x and y) else "SUBSTITUTE" if x and y else "DELETE" if x else "INSERT"
            out.append((kind, x, y))
    return out


_STEP = T.StructType([T.StructField("op", T.StringType()), T.StructField("expected", T.StringType()), T.StructField("seen", T.StringType())])


@F.pandas_udf(T.ArrayType(_STEP))
def char_alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "expected": x, "seen": y} for o, x, y in aligned(p or "", q or "")] for p, q in zip(a, b, strict=True)])
