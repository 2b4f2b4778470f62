"""Lists, names, hashes, splits and sizes derived from single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.classes import strip

SPLITS = (("train", 90), ("validation", 95), ("test", 100))
# Size buckets of a dataset card and the count each stays below.
SIZE_BUCKETS = ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K"), (1_000_000, "100K<n<1M"))

# How the console shows the status of a run, of a page and of a recognition profile.
RUN_PILLS = {"completed": "pill-success", "failed": "pill-error", "processing": "pill-active", "queued": "pill-warn"}
PAGE_CLASSES = {"pass": "page-pass", "warn": "page-warn", "fail": "page-fail", "empty": "page-empty"}
PROFILE_PILLS = {"default": "pill-success", "benchmark": "pill-warn"}


def shown_as(status: Column, known: dict[str, str], otherwise: str) -> Column:
    """What a status is shown as; ``otherwise`` for null and any other."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), status), F.lit(otherwise))


def filled(c: Column) -> Column:
    """The value, or null where it is an empty string."""
    return F.when(c != "", c)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty; null if there is none."""
    return F.coalesce(*[filled(c) for c in columns])


def text_hash(c: Column) -> Column:
    """Hexadecimal SHA-256 of the text in UTF-8; of the empty text for null."""
    return F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256)


def hash_bucket(key: Column) -> Column:
    """0 … 99 from the first 32 bits of the SHA-256 of a key."""
    return (F.conv(F.substring(text_hash(key), 1, 8), 16, 10).cast("bigint") % 100).cast("bigint")


def hash_split(key: Column) -> Column:
    """train, validation or test; equal keys always fall together."""
    bucket = hash_bucket(key)
    ladder = None
    for name, edge in SPLITS[:-1]:
        ladder = F.when(bucket < edge, name) if ladder is None else ladder.when(bucket < edge, name)
    return ladder.otherwise(SPLITS[-1][0])


def page_id(document: Column, number: Column) -> Column:
    return F.format_string("%s_page_%04d", document, number)


def file_stem(name: Column, document: Column) -> Column:
    """A name that file systems take: other characters as underscores, none at the ends, part of the id behind it."""
    plain = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_.-]+", "_"), r"^[._-]+|[._-]+\z", "")
    return F.concat(first_filled(plain, F.lit("document")), F.lit("__"), F.substring(document, 1, 8))


def artifact_stem(filename: Column) -> Column:
    """The name of a file without its suffix, each other character an underscore."""
    base = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*\z", "")
    return first_filled(F.regexp_replace(base, r"[^\p{L}\p{N}_.-]", "_"), F.lit("document"))


def language_list(c: Column) -> Column:
    """A comma list as an array of trimmed names; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ",", -1), strip), lambda x: x != "")


def json_list(c: Column, lenient: bool = True) -> Column:
    """A JSON array of values as strings; other JSON and, unless ``lenient``, broken JSON give no items.

    Broken JSON is read as a comma list where ``lenient``.
    """
    parsed = F.from_json(c, "array<string>")
    broken = language_list(c) if lenient else F.array().cast("array<string>")
    kind = F.typeof(F.try_parse_json(c))
    other = F.when(F.try_parse_json(c).isNotNull() & kind.isNotNull(), F.array().cast("array<string>")).otherwise(broken)
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.coalesce(parsed, other))


def size_bucket(n: Column) -> Column:
    ladder = None
    for below, label in SIZE_BUCKETS:
        ladder = F.when(n < below, label) if ladder is None else ladder.when(n < below, label)
    return ladder.otherwise("1M<n<10M")
