"""Writing direction, script family and language hints of a text.

The counts by Unicode class come from one Arrow function that looks each distinct character up once; all decisions on
top of them are column expressions.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.classes import strip

# Letters that hint at a language.
TURKISH = "çğıİöşüÇĞÖŞÜ"
OTTOMAN_LATIN = "ḳñāüûîâêôḫṣṭẓżḍġṇ"
# Words in a letter's Unicode name that mark it as an extended Latin letter.
MARKED = ("with", "accent", "cedilla", "breve", "circumflex", "dot", "stroke", "tilde", "diaeresis", "macron", "hook")


@lru_cache(100_000)
def traits(ch: str) -> tuple[bool, bool, bool, bool, bool]:
    """(left to right, right to left, Arabic letter, letter among the first, extended letter) of one character."""
    bidi, category = unicodedata.bidirectional(ch), unicodedata.category(ch)
    ltr, letter = bidi == "L", bidi == "L" and category[0] == "L"
    extended = letter and ord(ch) > 127 and category in ("Ll", "Lu") and any(m in unicodedata.name(ch, "").lower() for m in MARKED)
    return ltr, bidi in ("R", "AL", "AN"), bidi == "AL", letter, extended


COUNTS = T.StructType(
    [T.StructField(k, T.LongType()) for k in ("ltr", "rtl", "arabic", "latin", "extended")] + [T.StructField(k, T.StringType()) for k in ("rtl_sample", "ltr_sample")]
)


@F.pandas_udf(COUNTS)
def script_counts(texts: pd.Series) -> pd.DataFrame:
    """Characters of each kind, and the first five of either direction."""
    rows = []
    for t in texts:
        seen = Counter(t or "")
        ltr = rtl = arabic = latin = extended = 0
        for ch, n in seen.items():
            a, b, c, d, e = traits(ch)
            ltr, rtl, arabic, latin, extended = ltr + a * n, rtl + b * n, arabic + c * n, latin + d * n, extended + e * n
        samples = []
        for which in (1, 3):
            some: list[str] = []
            if (rtl, latin)[which == 3]:
                for ch in t:
                    if traits(ch)[which]:
                        some.append(ch)
                        if len(some) == 5:
                            break
            samples.append("".join(some))
        rows.append((ltr, rtl, arabic, latin, extended, *samples))
    return pd.DataFrame(rows, columns=["ltr", "rtl", "arabic", "latin", "extended", "rtl_sample", "ltr_sample"])


def direction(ltr: Column, rtl: Column) -> Column:
    """From counts of strong characters."""
    both = (ltr + rtl).cast("double")
    l, r = ltr / F.nullif(both, F.lit(0.0)), rtl / F.nullif(both, F.lit(0.0))
    return (
        F.when(both == 0, "undetermined").when(r > 0.8, "rtl").when(l > 0.8, "ltr").when((r > 0.15) & (l > 0.15), "mixed").when(r > l, "rtl").otherwise("ltr")
    )


def _rtl(text: str) -> bool:
    """Whether ``direction`` of a text's counts is right to left."""
    ltr = rtl = 0
    for ch, n in Counter(text).items():
        a, b, *_ = traits(ch)
        ltr, rtl = ltr + a * n, rtl + b * n
    both = ltr + rtl
    return bool(text.strip() and both) and (rtl / both > 0.8 or (rtl > ltr and not (rtl / both > 0.15 and ltr / both > 0.15)))


@F.pandas_udf(T.StringType())
def wrap_blocks(texts: pd.Series) -> pd.Series:
    """Of the blocks between blank lines those that are written from right to left inside an element that says so."""
    return texts.map(lambda t: t if t is None else "\n\n".join(f'<div dir="rtl">\n{b}\n</div>' if _rtl(b) else b for b in t.split("\n\n")))


def family(text: Column, way: Column, arabic: Column, latin: Column, extended: Column) -> Column:
    return (
        F.when((arabic > latin) & (arabic > 20), "arabic")
        .when(text.rlike(f"[{OTTOMAN_LATIN}]") & (extended > 5), "latin_extended")
        .when(way == "mixed", "mixed")
        .when(latin > 0, "latin")
        .otherwise("undetermined")
    )


def language_hints(text: Column, arabic: Column) -> Column:
    """Hints in a fixed order: tr, ar, ota, ota-latn."""
    turkish = text.rlike(f"[{TURKISH}]")
    return F.filter(
        F.array(
            F.when(turkish, "tr"), F.when(arabic > 50, "ar"), F.when(turkish & (arabic > 50), "ota"), F.when(text.rlike(f"[{OTTOMAN_LATIN}]"), "ota-latn")
        ),
        lambda x: x.isNotNull(),
    )


#: Fields of ``analysis``.
ANALYSIS = (
    "direction", "primary_script", "ltr_ratio", "rtl_ratio", "arabic_char_count", "latin_char_count", "extended_latin_count", "has_diacritics", "sample_rtl_chars", "sample_ltr_chars", "detected_languages",
)


def analysis(text: Column, counts: Column) -> Column:
    """Struct of everything known about a text, from its counts; a blank text is undetermined and all zero."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    n = {k: F.when(blank, F.lit(0)).otherwise(counts[k]).cast("bigint") for k in ("ltr", "rtl", "arabic", "latin", "extended")}
    way = direction(n["ltr"], n["rtl"])
    both = F.nullif((n["ltr"] + n["rtl"]).cast("double"), F.lit(0.0))
    return F.struct(
        way.alias("direction"),
        F.when(blank, "undetermined").otherwise(family(text, way, n["arabic"], n["latin"], n["extended"])).alias("primary_script"),
        F.coalesce(n["ltr"] / both, F.lit(0.0)).alias("ltr_ratio"),
        F.coalesce(n["rtl"] / both, F.lit(0.0)).alias("rtl_ratio"),
        n["arabic"].alias("arabic_char_count"), n["latin"].alias("latin_char_count"), n["extended"].alias("extended_latin_count"),
        (n["extended"] > 5).alias("has_diacritics"),
        F.when(blank, "").otherwise(counts["rtl_sample"]).alias("sample_rtl_chars"),
        F.when(blank, "").otherwise(counts["ltr_sample"]).alias("sample_ltr_chars"),
        F.when(blank, F.array().cast("array<string>")).otherwise(language_hints(text, n["arabic"])).alias("detected_languages"),
    )


def blocks(text: Column) -> Column:
    """The stripped blocks between blank lines that hold anything."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), strip), lambda x: x != "")
