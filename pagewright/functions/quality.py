"""Page quality rules: repetition, lack of variety, leftover markers, divided words, leaked markup."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions.classes import LETTER, NOT_SPACE, SPACE, strip, text_lines
from pagewright.functions.clean import LEAK_TAGS

LEAST_CHARS = 20
REPEATED, REPEATED_MUCH = 0.35, 0.60
ONE_CHARACTER = 0.50
RUN = 5


def longest_run(lines: Column) -> Column:
    """Length of the longest row of equal neighbours; 0 for no lines."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, x):
        now = F.when(acc["last"] == x, acc["now"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(lines, start, step, lambda acc: acc["most"])


@F.pandas_udf(T.StructType([T.StructField("ch", T.StringType()), T.StructField("n", T.LongType())]))
def _top_character(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        # of equals the first: a counter keeps the order in which it met them
        top = Counter((t or "").replace(" ", "").replace("\n", "")).most_common(1)
        rows.append(top[0] if top else (None, None))
    return pd.DataFrame(rows, columns=["ch", "n"]).astype({"n": "Int64"})


#: (character, count) of the most frequent character beside blanks and line breaks; of equals the first, nulls for a text of none. One look
#: at each character, whatever the alphabet. It is said not to be deterministic so that no filter is pushed below it and no rule is evaluated twice.
dominant_character = _top_character.asNondeterministic()


def marker_artifacts(text: Column) -> Column:
    """Whether a marker of the model stands several times in a row."""
    return text.rlike(r"(<\|det\|>){3,}|(<\|grounding\|>){2,}")


def repeated_unit(text: Column) -> Column:
    """Whether a piece without blanks, with the blanks behind it if any, stands eleven times or more in a row.

    Said in one pattern this backtracks over every length of every word. Said in two it hardly does: a unit without blanks lies
    inside a word of eleven characters or more, and one with blanks ends where its word ends.
    """
    inside = rf"(?={NOT_SPACE}{{11}})({NOT_SPACE}+?)\1{{10,}}"
    across = rf"({NOT_SPACE}++{SPACE}++)\1{{10,}}"
    return text.rlike(inside) | text.rlike(across)


def with_quality(df: DataFrame, text: str, page: str) -> DataFrame:
    """Add ``quality``: a struct of status, issues, flags and metrics.

    A text shorter than 20 characters when stripped is ``empty``, has one issue and no metrics but its length. Null counts as
    empty. Extra columns stay; names starting with ``__q`` are used inside. A filter on ``quality`` stays above the rules.
    """
    t = F.col("__q_text")
    step1 = df.withColumn("__q_text", strip(F.coalesce(F.col(text), F.lit(""))))
    step2 = (
        step1.withColumn("__q_lines", text_lines(t))
        .withColumn("__q_all", F.length(F.regexp_replace(t, "[ \n]", "")))
        .withColumn("__q_artifact", marker_artifacts(t) | repeated_unit(t))
        .withColumn(
            "__q_hyphens",
            F.regexp_count(t, F.lit(rf"{LETTER}{{2,}}-{SPACE}*\n{SPACE}*{LETTER}{{2,}}")) + F.regexp_count(t, F.lit(rf"{LETTER}{{2,}}-{SPACE}{{1,3}}{LETTER}{{2,}}")),
        )
        .withColumn("__q_markup", t.rlike(rf"(?i)</?({LEAK_TAGS})\b[^>]*>"))
    )
    lines, n = F.col("__q_lines"), F.size("__q_lines")
    step3 = step2.withColumn("__q_unique", F.size(F.array_distinct(lines))).withColumn("__q_run", longest_run(lines)).withColumn("__q_top", dominant_character(t))
    ratio = 1 - F.col("__q_unique") / n
    share = F.coalesce(F.col("__q_top.n") / F.nullif(F.col("__q_all"), F.lit(0)), F.lit(0.0))
    p = F.col(page)
    percent = lambda x: F.format_string("%.0f%%", F.bround(x * 100, 0))
    say = lambda fmt, *cols: F.format_string("Page %d: " + fmt, p, *cols)
    issues = F.filter(
        F.array(
            F.when((n > 0) & (ratio > REPEATED_MUCH), say("extreme repetition (%s duplicate lines)", percent(ratio))).when(
                (n > 0) & (ratio > REPEATED), say("moderate repetition (%s duplicate lines)", percent(ratio))
            ),
            F.when(F.col("__q_run") >= RUN, say("%d consecutive identical lines", F.col("__q_run"))),
            F.when(share > ONE_CHARACTER, say("'%s' is %s of output", F.col("__q_top.ch"), percent(share))),
            F.when(F.col("__q_artifact"), say("model artifact detected")),
            F.when(F.col("__q_hyphens") > 0, say("line-break hyphenation remains (%d segment(s))", F.col("__q_hyphens"))),
            F.when(F.col("__q_markup"), say("markup tag leaked into clean text")),
        ),
        lambda x: x.isNotNull(),
    )
    short = F.length(t) < LEAST_CHARS
    fail = ((n > 0) & (ratio > REPEATED_MUCH)) | F.col("__q_artifact") | (share > ONE_CHARACTER)
    full = lambda c: F.when(~short, c)
    flags = F.filter(F.array(F.when(F.col("__q_hyphens") > 0, "line_hyphenation"), F.when(F.col("__q_markup"), "markup_leak")), lambda x: x.isNotNull())
    return step3.withColumn(
        "quality",
        F.struct(
            F.when(short, "empty").when(fail, "fail").when(F.size(issues) > 0, "warn").otherwise("pass").alias("status"),
            F.when(short, F.array(say("output too short (%d chars)", F.length(t)))).otherwise(issues).alias("issues"),
            F.when(short, F.array().cast("array<string>")).otherwise(flags).alias("flags"),
            F.length(t).cast("bigint").alias("text_length"),
            full(n).cast("bigint").alias("total_lines"), full(F.col("__q_unique")).cast("bigint").alias("unique_lines"),
            full(ratio).alias("repetition_ratio"), full(F.col("__q_run")).cast("bigint").alias("max_consecutive_dupes"),
            full(F.col("__q_top.ch")).alias("dominant_char"), full(F.col("__q_top.n")).cast("bigint").alias("dominant_char_count"), full(share).alias("dominant_char_ratio"),
            full(F.col("__q_hyphens")).cast("bigint").alias("line_hyphenation_count"),
        ),
    ).drop(*[c for c in step3.columns if c.startswith("__q")])
