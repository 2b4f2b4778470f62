"""Pages of documents: cut from and joined to whole texts, measured, profiled, picked among attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.classes import text_lines, words
from pagewright.functions.labels import page_id
from pagewright.functions.quality import with_quality
from pagewright.functions.script import ANALYSIS, analysis, script_counts

PAGE_BREAK = "\n\f\n"
#: Extraction modes in the order they are tried on a page.
STRATEGIES = ("markdown", "free_ocr", "ocr_image")


def split_pages(text: Column, total_pages: Column | None = None) -> Column:
    """The pages of a text as an array; with ``total_pages`` padded with empty pages or cut to that number."""
    parts = F.split(F.coalesce(text, F.lit("")), PAGE_BREAK, -1)
    if total_pages is None:
        return parts
    n = F.greatest(F.coalesce(total_pages.cast("int"), F.lit(0)), F.lit(0))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(""), n)), 1, n)


def explode_pages(df: DataFrame, text: str, total_pages: str | None = None, number: str = "page_num", out: str = "page_text") -> DataFrame:
    """One row per page with its number from 1; a document of no pages gives no row."""
    pages = split_pages(F.col(text), F.col(total_pages) if total_pages else None)
    kept = [c for c in df.columns if c not in (number, out)]
    return df.select(*kept, F.posexplode(pages).alias(number, out)).withColumn(number, F.col(number) + 1)


def join_pages(df: DataFrame, keys: list[str], text: str, number: str = "page_num", out: str = "text") -> DataFrame:
    """The pages of each document in order, joined by the page break; null pages count as empty.

    A document's pages meet in one task by the nature of the result, one string.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), PAGE_BREAK).alias(out))


def measures(text: Column) -> Column:
    """Struct of characters, words, lines with text and the rough token count, the whole part of 1.3 x words."""
    t = F.coalesce(text, F.lit(""))
    n = F.size(words(t)).cast("bigint")
    return F.struct(
        F.length(t).cast("bigint").alias("chars"), n.alias("words"), F.size(text_lines(t)).cast("bigint").alias("lines"),
        F.floor(n.cast("double") * F.lit(1.3)).cast("bigint").alias("tokens_approx"),
    )


def page_profile(text_length: Column, image_count: Column, blocks: Column, most_lines: Column, width: Column, height: Column) -> Column:
    """How a page is to be read: whether it has text, how complex it is, and the resolution to draw it at."""
    has_text, has_images = text_length > 50, image_count > 0
    return F.struct(
        has_text.alias("has_embedded_text"), has_images.alias("has_images"), (width > height).alias("is_landscape"),
        F.when((most_lines > 5) | (blocks > 20), "complex").when((blocks > 5) | has_images, "moderate").otherwise("simple").alias("estimated_complexity"),
        F.when(~has_text & has_images, 300).otherwise(200).alias("recommended_dpi"), F.lit("markdown").alias("recommended_mode"),
        (~has_text & has_images).alias("is_image_only"),
    )


def pick_attempt(attempts: DataFrame, keys: list[str], attempt: str, status: str) -> DataFrame:
    """Of the attempts at each page the first that passes or warns, else the last."""
    good = F.col(status).isin("pass", "warn")
    order = Window.partitionBy(*keys).orderBy(F.when(good, 0).otherwise(1), F.when(good, F.col(attempt)).otherwise(-F.col(attempt)))
    return attempts.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def with_page_id(df: DataFrame, document: str = "document_id", number: str = "page_num") -> DataFrame:
    return df.withColumn("page_id", page_id(F.col(document), F.col(number)))


def page_metadata(pages: DataFrame, text: str = "clean_text") -> DataFrame:
    """The record of every page: its keys and what was measured while it was read, with lengths, script and quality worked out from ``text``.

    ``pages`` has ``page_num`` and may have any other columns, which stay. Added are ``chars, words, lines, tokens_approx``, the fields of the script
    analysis, and ``status, issues, flags, repetition_ratio`` of the quality rules. Null texts count as empty.
    """
    judged = with_quality(pages, text, "page_num")
    counted = judged.withColumn("__m", measures(F.col(text))).withColumn("__n", script_counts(text))
    told = counted.withColumn("__a", analysis(F.col(text), F.col("__n")))
    made = ("chars", "words", "lines", "tokens_approx", "status", "issues", "flags", "repetition_ratio", *ANALYSIS)
    kept = [F.col(c) for c in pages.columns if c not in made]
    return told.select(*kept, "__m.*", *[f"__a.{c}" for c in ANALYSIS], *[f"quality.{c}" for c in ("status", "issues", "flags")], F.coalesce("quality.repetition_ratio", F.lit(0.0)).alias("repetition_ratio"))
