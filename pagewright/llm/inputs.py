"""The tables as these operators want them: repeated rows once, labels in one spelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.fold import fold_letters
from pagewright.sources.tables import table

# What catalog labels call each language, folded to bare lower-case letters.
LANGUAGE_NAMES = {
    "tr": ("tr", "tur", "turkish", "turkce", "turc", "turkisch"),
    "ota-latn": ("ota-latn", "osmanlica (latin)", "osmanlica latin", "latin osmanlica", "ottoman turkish in latin letters", "ottoman (latin)", "ottoman turkish (latin)", "osmanlica (latin harfli)"),
    "ota": ("ota", "ota-arab", "osmanlica", "ottoman", "ottoman turkish", "ottoman turkish in arabic letters", "osmanlica (arap)", "ottoman (arabic)"),
    "ar": ("ar", "ara", "arb", "arabic", "arapca", "arabe", "arabisch", "العربية", "عربي"),
    "en": ("en", "eng", "english", "ingilizce", "anglais", "englisch"),
    "fr": ("fr", "fra", "fre", "french", "fransizca", "francais", "franzosisch"),
    "de": ("de", "deu", "ger", "german", "almanca", "deutsch", "allemand"),
}


def language_code(label: Column) -> Column:
    """One catalog label as a code of ``language_codes``; null for blanks and words that name none.

    Regional codes (``tr-TR``, ``en_GB``) count as their language.
    """
    name = F.regexp_replace(F.trim(fold_letters(label)), r"\s+", " ")
    entries = [F.lit(x) for code, names in LANGUAGE_NAMES.items() for n in names for x in (n, code)]
    known = F.create_map(*entries)
    return F.coalesce(F.try_element_at(known, name), F.try_element_at(known, F.regexp_extract(name, r"^([a-z]{2})[-_][a-z]{2}$", 1)))


def language_set(labels: Column) -> Column:
    """A comma list of labels as the sorted array of the codes it names; empty for null."""
    parts = F.split(F.coalesce(labels, F.lit("")), "[,;/]")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, language_code), lambda x: x.isNotNull())))


def slug(c: Column) -> Column:
    """Source or group label in one spelling: trimmed, lower-case, ``unknown`` for null or blank."""
    plain = F.lower(F.replace(F.regexp_replace(F.trim(c), r"\s+", " "), F.lit("İ"), F.lit("i")))
    return F.when(F.length(plain) > 0, plain).otherwise(F.lit("unknown"))


def domain(group_path: Column) -> Column:
    """First level of ``domain/sub-domain`` in one spelling."""
    return slug(F.split(group_path, "/", 2)[0])


def pages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Distinct rows of ``pages`` over the given columns."""
    return table(spark, sf_dir, "pages", *columns).dropDuplicates()


def drawn(df: DataFrame, ident: str, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each label at most, chosen by all 64 bits of a hash of ``ident``; there are few labels, codes of a fixed list."""
    shares = {r[0]: min(1.0, most / r[1]) for r in df.groupBy(label).agg(F.count(F.lit(1))).collect() if r[0] is not None}
    if not shares:
        return df.limit(0)
    at = (F.xxhash64(ident).cast("double") + 2.0**63) / 2.0**64
    share = F.try_element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(v))]), F.col(label))
    return df.filter(at <= F.coalesce(share, F.lit(-1.0)))


def language_sql(label: str) -> str:
    """``language_code`` of one label as SQL."""
    name = f"trim(regexp_replace(lower(regexp_replace(strip_accents(replace(replace({label}, 'ı', 'i'), 'İ', 'i')), '[\\p{{M}}\\p{{Cf}}ʿʾ’‘''`´]', '', 'g')), '\\s+', ' ', 'g'))"
    cases = " ".join(f"WHEN x IN ({', '.join(repr(n) for n in dict.fromkeys((*names, code)))}) THEN '{code}'" for code, names in LANGUAGE_NAMES.items())
    regional = cases.replace("WHEN x IN", "WHEN regexp_extract(x, '^([a-z]{2})[-_][a-z]{2}$', 1) IN")
    return f"(list_transform([{name}], lambda x: CASE {cases} {regional} END)[1])"


class Once:
    """A value to broadcast, and what a worker makes of it: built at first use and kept for its later tasks."""

    def __init__(self, make, value):
        self.make, self.value, self.made = make, value, None

    def __getstate__(self):
        return {"make": self.make, "value": self.value, "made": None}

    def get(self):
        if self.made is None:
            self.made = self.make(self.value)
        return self.made
