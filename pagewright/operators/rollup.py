"""Roll-ups from pages to documents, runs and dataset cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.labels import size_bucket

STATUSES = ("pass", "warn", "fail", "empty")


def dominant(df: DataFrame, keys: list[str], value: str, position: str, out: str, default: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first by ``position``; ``default`` where all are null."""
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    best = each.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(out))
    return df.select(*keys).distinct().join(best, keys, "left").withColumn(out, F.coalesce(out, F.lit(default)))


def distinct_items(lists: Column) -> Column:
    """Sorted distinct items of the arrays of a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(lists, F.array().cast("array<string>"))))))


def document_totals(pages: DataFrame, keys: tuple[str, ...] = ("run_id", "document_id")) -> DataFrame:
    """Counts, sums and languages of each document of a run from its pages; null measures count as 0.

    Repeated page rows must be dropped before. Times are kept in tenths of a millisecond, whole numbers that add up the same in any order.
    """
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    tenths = F.sum(F.coalesce(F.round(F.col("processing_time_ms") * 10).cast("bigint"), F.lit(0)))
    return pages.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pages"), zero("text_length_chars").alias("total_chars"), zero("text_length_words").alias("total_words"),
        zero("token_count_cl100k").alias("total_tokens"), tenths.alias("total_time_tenths"),
        *[F.count_if(F.col("status") == s).alias(f"pages_{s}") for s in STATUSES],
        *[F.count_if(F.col("script_direction") == s).alias(f"pages_{s}") for s in ("ltr", "rtl", "mixed")],
        distinct_items(F.col("detected_languages")).alias("languages_detected"), distinct_items(F.col("quality_flags")).alias("quality_flags"),
    )


def run_totals(documents: DataFrame) -> DataFrame:
    """Sums over the documents of each run."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    return documents.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("documents"), *[zero(f"pages_{s}").alias(f"pages_{s}") for s in STATUSES], zero("total_pages").alias("pages_total_estimate"),
        F.sum(F.coalesce(F.round(F.col("total_processing_time_ms") * 10).cast("bigint"), F.lit(0))).alias("total_time_tenths"),
    )


def dataset_card(documents: DataFrame) -> DataFrame:
    """One row per run with what its card states: totals, sorted scripts and languages, size bucket."""
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    languages = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.from_json("languages_detected", "array<string>"), F.array().cast("array<string>"))))))
    card = documents.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("documents"), zero("total_pages").alias("pages"), *[zero(f"pages_{s}").alias(f"pages_{s}") for s in STATUSES],
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("dominant_script") != "", F.col("dominant_script")))), ", ").alias("scripts"),
        F.array_join(languages, ", ").alias("languages"),
    )
    return card.withColumn("size_category", size_bucket(F.col("pages")))


#: A dataset card with the places its numbers take.
CARD = """---
license: cc-by-4.0
task_categories:
  - text-generation
  - feature-extraction
language:
  - %s
size_categories:
  - %s
---
# Pages of run `%s`

Read by `%s` with pipeline %s; finished on %s.

| | count |
|-|-|
| documents | %d |
| pages | %d |
| passed | %d |
| with warnings | %d |
| failed | %d |
| empty | %d |

Scripts: %s.

## Files

`pages.parquet` has a row for each page with its raw and cleaned text, `documents.parquet` one for each document with its pages joined.

## Loading

```python
spark.read.parquet("pages.parquet").where("split = 'train'")
```

## Splits

The column `split` follows from the SHA-256 of the source file: 90 %% train, 5 %% validation, 5 %% test. All pages of a document share it.
"""


def card_text(card: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_id, card``: the card of each run as front matter, counts and notes in Markdown; ``en`` where no language is known."""
    languages = F.replace(F.when(F.col("languages") == "", "en").otherwise(F.col("languages")), F.lit(", "), F.lit("\n  - "))
    day = F.date_format(F.coalesce("completed_at", "created_at"), "yyyy-MM-dd")
    known = lambda c: F.coalesce(c, F.lit("n/a"))
    return card.join(runs.select(F.col("id").alias("run_id"), "model_used", "pipeline_version", "completed_at", "created_at"), "run_id").select(
        "run_id",
        F.format_string(
            CARD, languages, "size_category", "run_id", known("model_used"), known("pipeline_version"), known(day),
            "documents", "pages", "pages_pass", "pages_warn", "pages_fail", "pages_empty", F.when(F.col("scripts") == "", "unknown").otherwise(F.col("scripts")),
        ).alias("card"),
    )
