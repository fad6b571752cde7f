"""Cleaning of texts read from screens: tags, names, powers, identities, servers, and where two names differ."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words before a server's number, in the order in which they count; the first stands for the bare sign.
SERVER_WORDS = ("", "Warzone", "Wagzone", "Waqzone", "Waizone", "Wauzone", "Watzone", "Wagzong", "Waqzong", "Qagzone", "Qagzong", "[WQ][a-zA-Z]{2,12}", "Kriegszone", r"Zona(?:\s+de\s+guerra)?", r"Zone(?:\s+de\s+guerre)?")
# Words that make a line a heading.
HEADINGS = ("ALLIANCE POWER", "TOTAL HERO POWER", "RANKING", "ALLIANCE NAME", "COMMANDER", "POWER", "NOTE:", "LEADERBOARD", "UPDATES", "IMPORTANT", "PRESIDENT")
# Forms of a line that names a war zone.
WARZONE = (r"(?i)[WQ][a-zA-Z0-9,\.\s]*z[oa][nmg][a-zA-Z0-9,\.\s]*[#\{\}]?\s*\d{3,4}", r"(?i)Warzone\s*[#\{\}]?\s*\d{3,4}")
POWER_LIKE = r"[0-9OIl|][0-9OIl|,\.\s-]{6,}[0-9OIl|]"
# Fixed value: a tag in brackets inside an identity.
IDENTITY_TAG = r"\[\s*([A-Za-z0-9]{2,6})\s*\]"
# Groups of characters that screen reading confuses.
CONFUSIONS = ("0OoQD", "1lIi|", "2Zz", "5Ss", "6Gb", "8B", "4A", "9gq", "uv", "ce", "rn", "m")

RESULT = "struct<value: string, confidence: double, corrected: boolean>"


def server_candidates(text: Column) -> Column:
    """All servers a text names, in the order of the forms and then of the places; of four digits beginning with 8 the last three count."""
    found = []
    for word in SERVER_WORDS:
        pattern = rf"(?i){word}\s*[#\{{\}}]?\s*(\d{{3,4}})" if word else r"[#＃]\s*(\d{3,4})"
        found.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    number = lambda n: F.when((F.length(n) == 4) & n.startswith("8"), F.substring(n, 2, 3)).otherwise(n).cast("int")
    return F.transform(F.concat(*found), number)


def is_warzone(text: Column) -> Column:
    return text.rlike(WARZONE[0]) | text.rlike(WARZONE[1])


def clean_power(text: Column) -> Column:
    """The first number of at least seven digits, letters that are read for digits put right; null without one."""
    digits = F.regexp_replace(F.translate(F.regexp_extract(text, POWER_LIKE, 0), "OoIl|", "00111"), "[^0-9]", "")
    return F.when(F.length(digits) >= 7, digits.try_cast("bigint"))


def clean_name_part(text: Column) -> Column:
    """The trimmed text, or '' if it is a heading, a war zone, a rank or a power."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    heading = F.lit(False)
    for word in HEADINGS:
        heading = heading | F.upper(t).contains(word)
    return F.when(heading | is_warzone(t) | t.rlike(r"^\d{1,3}$") | clean_power(t).isNotNull(), "").otherwise(t)


def _result(value: Column, confidence: Column, corrected: Column) -> Column:
    return F.struct(value.alias("value"), F.round(F.greatest(confidence, F.lit(0.0)), 4).alias("confidence"), corrected.alias("corrected"))


def _one_blank(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalize_tag(tag: Column) -> Column:
    """A tag without brackets and other marks; a change costs 0.05."""
    before = _one_blank(tag)
    after = F.regexp_replace(before, "[^A-Za-z0-9]", "")
    return _result(after, F.when(after == before, 1.0).otherwise(0.95), after != before)


def normalize_name(name: Column) -> Column:
    """A name in one form, without marks at its ends, a zero between letters and a last l after r put right; empty becomes UNKNOWN."""
    before = _one_blank(name)
    bare = F.trim(F.regexp_replace(_nfkc(before), r"^[\s\[\](){}|]+|[\s\[\](){}|]+$", ""))
    zero = F.regexp_replace(bare, "(?<=[A-Za-z])0(?=[A-Za-z])", "o")
    ell = F.regexp_replace(zero, "(?i)(?<=r)l$", "i")
    cost = F.when(bare != before, 0.03).otherwise(0.0) + F.when(zero != bare, 0.05).otherwise(0.0) + F.when(ell != zero, 0.04).otherwise(0.0)
    return _result(F.when(ell == "", "UNKNOWN").otherwise(ell), F.lit(1.0) - cost, ell != before)


def normalize_power(power: Column) -> Column:
    """Digits of a power, letters that are read for digits put right."""
    before = F.coalesce(power, F.lit(""))
    moved = F.translate(before, "OoIl|", "00111")
    digits = F.regexp_replace(moved, "[^0-9]", "")
    cost = F.when(moved != before, 0.04).otherwise(0.0) + F.when(digits != F.regexp_replace(before, "[^0-9]", ""), 0.02).otherwise(0.0)
    return _result(digits, F.lit(1.0) - cost, moved != before)


def parse_identity(raw: Column, base: Column) -> Column:
    """Tag, name, confidence and status of a raw identity.

    What stands before a tag in brackets is ignored; a missing tag is allowed; a
    name without letters or digits, or one that is a heading, is UNKNOWN and
    makes the status REVIEW.
    """
    text = _one_blank(F.regexp_replace(F.translate(_nfkc(F.coalesce(raw, F.lit(""))), "｜", "|"), r"[\x00-\x1f\x7f-\x9f]", " "))
    tag = F.nullif(F.regexp_extract(text, IDENTITY_TAG, 1), F.lit(""))
    rest = F.when(tag.isNull(), text).otherwise(F.regexp_replace(text, r"^.*?\[\s*[A-Za-z0-9]{2,6}\s*\]\s*", ""))
    name = _one_blank(F.regexp_replace(rest, r"\b\d{7,}\b.*$", ""))
    unusable = ~name.rlike(r"[A-Za-z0-9]|[^\x00-\x7f]") | F.lower(name).rlike("warzone|total hero|alliance power")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(base.cast("double"), F.lit(1.0))))
    confidence = F.when(unusable, F.least(sure, F.lit(0.25))).when(tag.isNotNull(), F.greatest(sure, F.lit(0.80))).otherwise(F.least(F.greatest(sure, F.lit(0.65)), F.lit(0.85)))
    return F.struct(
        tag.alias("tag"), F.when(unusable, "UNKNOWN").otherwise(name).alias("name"), F.round(confidence, 4).alias("confidence"),
        F.when(unusable | (confidence < 0.35), "REVIEW").otherwise("VALID").alias("status"),
    )


def _nfkc(c: Column) -> Column:
    """Compatibility form; plain ASCII never leaves the JVM."""
    return F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(_nfkc_udf(c))


@F.pandas_udf(T.StringType())
def _nfkc_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


def edit_steps(a: str, b: str) -> list[tuple[str, int, str, str]]:
    """(op, place in ``a``, expected, observed) of a cheapest edit; going back, a diagonal step is preferred to an insertion and that to a deletion."""
    n, m = len(a), len(b)
    cost = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i or not j:
                cost[i][j] = i + j
            else:
                cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i][j - 1] + 1, cost[i - 1][j] + 1)
    steps, i, j = [], n, m
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            steps.append(("equal" if a[i] == b[j] else "replace", i, a[i], b[j]))
        elif j and cost[i][j] == cost[i][j - 1] + 1:
            j -= 1
            steps.append(("insert", i, "", b[j]))
        else:
            i -= 1
            steps.append(("delete", i, a[i], ""))
    return steps[::-1]


def reason(expected: str, observed: str) -> str:
    """Whether two characters belong to one family of confusions, one of them to any, or neither."""
    if expected and observed and any(expected in g and observed in g for g in CONFUSIONS):
        return "same_confusion_family_difference"
    if any(c and c in g for g in CONFUSIONS for c in (expected, observed)):
        return "ocr_confusable_character_difference"
    return "display_character_difference"


_STEP = T.StructType([T.StructField("op", T.StringType()), T.StructField("place", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("expected", "observed", "reason")]])


@F.pandas_udf(T.ArrayType(_STEP))
def character_differences(expected: pd.Series, observed: pd.Series) -> pd.Series:
    """The steps of :func:`edit_steps` that change something, with their reasons; null texts count as empty."""
    out = []
    for a, b in zip(expected, observed, strict=True):
        out.append([{"op": op, "place": at, "expected": e, "observed": o, "reason": reason(e, o)} for op, at, e, o in edit_steps(a or "", b or "") if op != "equal"])
    return pd.Series(out)
