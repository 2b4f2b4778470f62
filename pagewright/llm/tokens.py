"""Token budget per source and language (problem 3), and the token counts other operators start from.

A per-language regression predicts the tokens of a text from its bytes, words, digits, punctuation
and script counts. It is fitted on a bounded sample that is really tokenized, corrected by the bias a second, disjoint tokenized
sample shows, and then applied to every text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import charstats
from pagewright.llm.inputs import domain, drawn, language_code, language_sql, slug
from pagewright.sources.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that cuts text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one language tokenized at most to fit the regression, and as many again to correct its bias.
SAMPLE = 600
# The script families a page is put into.
SCRIPTS = ("arabic", "latin_extended", "mixed", "latin")
#: A recorded count this many times off the estimate is looked at, and so is a page whose estimate is that of no usual text.
OFF, UNUSUAL = 1.25, 4.0


@lru_cache(4)
def encoder(path: str):
    """The tokenizer of a rank file: one every worker can open, or one sent with ``SparkContext.addFile`` and named by its file name."""
    import os

    import tiktoken
    from pyspark import SparkFiles

    with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pages", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], path: str = TOKENIZER, out: str = "n_tokens") -> DataFrame:
    """``keep`` and the exact number of tokens of ``text``; a null or empty text has 0."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, {out} bigint")


def text_features(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` and charstats.FEATURES of ``text``; with ``path`` also n_tokens, really tokenized."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    names = [*charstats.FEATURES, *(["n_tokens"] if path else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            rows = charstats.counts(texts)
            columns = [pa.array(rows[:, i]) for i in range(rows.shape[1])]
            if path:
                enc = encoder(path)
                columns.append(pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*keep, *names])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, fields + ", " + ", ".join(f"{n} bigint" for n in names))


def fit(rows: list, ridge: float = 1e-3, least: int = 30) -> dict[str, list[float]]:
    """Coefficients by language from rows of (language, features…, tokens, holdout).

    A language with fewer than ``least`` fitting rows takes the coefficients over all rows. Each language's
    coefficients are scaled by tokens / predicted tokens over its holdout rows, where it has as many.
    """
    if not rows:
        return {"": [0.0] * len(charstats.FEATURES)}
    lang = np.array([r[0] for r in rows])
    x = np.array([r[1:-2] for r in rows], float)
    y, held = np.array([r[-2] for r in rows], float), np.array([r[-1] for r in rows], bool)

    def solve(own: np.ndarray) -> np.ndarray:
        # relative errors count alike in short and long texts
        w = 1 / np.sqrt(np.maximum(y[own], 8))[:, None]
        a, scale = x[own] * w, np.maximum(np.abs(x[own] * w).max(0), 1e-9)
        a = a / scale
        return np.linalg.solve(a.T @ a + ridge * np.eye(x.shape[1]), a.T @ (y[own] * w[:, 0])) / scale

    out = {}
    everything = solve(~held if (~held).sum() >= least else np.ones(len(y), bool))
    for code in ["", *sorted(set(lang))]:
        own = np.ones(len(y), bool) if code == "" else lang == code
        beta = solve(own & ~held) if code and (own & ~held).sum() >= least else everything
        test = own & held
        predicted = (x[test] @ beta).sum()
        out[str(code)] = [float(b) for b in beta * (y[test].sum() / predicted if test.sum() >= least and predicted > 0 else 1.0)]
    return out


def estimate_tokens(df: DataFrame, text: str, language: str, keep: list[str], ident: str, path: str = TOKENIZER, sample: int = SAMPLE) -> DataFrame:
    """``keep``, charstats.FEATURES and ``est_tokens`` for every row.

    The fitting and the holdout sample are at most about ``sample`` rows of each language, drawn by a hash of ``ident``. A null
    language is fitted as a language of its own; a null or empty text is estimated at 0; repeated rows are
    kept as they are; an empty table gives an empty result.
    """
    code = F.coalesce(F.col(language), F.lit(""))
    some = drawn(df.select(ident, code.alias("__l"), F.col(text)), ident, "__l", 2 * sample)
    taken = text_features(some.select("__l", (F.pmod(F.xxhash64(ident, F.lit(1)), F.lit(2)) == 1).alias("__h"), text), text, ["__l", "__h"], path)
    rows = [(r["__l"], *(r[f] for f in charstats.FEATURES), r["n_tokens"], r["__h"]) for r in taken.collect()]
    model = fit(rows)
    features = text_features(df, text, keep)
    spark = df.sparkSession
    small = spark.createDataFrame([(k, v) for k, v in model.items() if k], "`__l` string, beta array<double>")
    joined = features.join(F.broadcast(small), F.coalesce(F.col(language), F.lit("")) == F.col("__l"), "left")
    beta = F.coalesce(F.col("beta"), F.array(*[F.lit(float(v)) for v in model[""]]))
    raw = sum((F.col(f) * F.element_at(beta, i + 1) for i, f in enumerate(charstats.FEATURES)), F.lit(0.0))
    return joined.withColumn("est_tokens", F.round(F.greatest(raw, F.when(F.col("n_chars") > 0, 1.0).otherwise(0.0))).cast("bigint")).drop("__l", "beta")


def catalog_language(labels, feed):
    """First code the catalog label names, else the delivering feed's guess, else ``und``."""
    first = language_code(F.split(labels, "[,;/]")[0])
    return F.coalesce(first, language_code(feed), F.lit("und"))


def audit_pages(pages: DataFrame, language: str) -> DataFrame:
    """Recorded counts of pages against their estimate: ``run_id, page_id, recorded, words, est_tokens, usable, trusted``.

    A count that is null, zero or negative, that is more than OFF times off the estimate, or whose page has an estimate more than UNUSUAL times
    off 1.3 x words is suspect. A suspect count is unusable where it is more than five times or less than a fifth of the whole part of 1.3 x
    words; a count within OFF of an estimate within UNUSUAL cannot be. Pages of fewer than 20 words are not judged
    (``usable`` is null). ``trusted`` is the recorded count where it is usable, else the estimate.
    """
    est = estimate_tokens(pages, "clean_text", language, ["run_id", "page_id", "token_count_cl100k", language], "page_id")
    rough, count, told = F.expr("n_words * 13 div 10"), F.col("token_count_cl100k"), F.col("est_tokens")
    empty = count.isNull() | (count <= 0)
    suspect = empty | (count > told * OFF) | (count * OFF < told) | (told > rough * UNUSUAL) | (told * UNUSUAL < rough)
    bad = suspect & (empty | (count > rough * 5) | (count * 5 < rough))
    usable = F.when(F.col("n_words") >= 20, ~bad)
    return est.select(
        "run_id", "page_id", count.alias("recorded"), F.col("n_words").alias("words"), "est_tokens", usable.alias("usable"),
        F.when(F.coalesce(usable, ~suspect), count).otherwise(told).alias("trusted"),
    )


def trusted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: ``doc_id, source, language, domain, n_chars, est_tokens``."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "language", "group_path")
    docs = docs.select(
        "doc_id", "text", slug(F.col("source")).alias("source"),
        catalog_language(F.col("language"), F.col("lang")).alias("language"), domain(F.col("group_path")).alias("domain"),
    )
    est = estimate_tokens(docs, "text", "language", ["doc_id", "source", "language", "domain"], "doc_id")
    return est.select("doc_id", "source", "language", "domain", "n_chars", "est_tokens")


# ---------------------------------------------------------------- queries


def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted count of every document."""
    return trusted_counts(spark, sf_dir)


def p3_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens of every source, language and domain, and of all."""
    each = trusted_counts(spark, sf_dir)
    slices = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source").alias("slice")),
        F.struct(F.lit("language").alias("kind"), F.col("language").alias("slice")),
        F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("slice")),
        F.struct(F.lit("all").alias("kind"), F.lit("all").alias("slice")),
    )
    return (
        each.select(F.explode(slices).alias("s"), "n_chars", "est_tokens")
        .groupBy("s.kind", "s.slice")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.sum("est_tokens").alias("tokens"))
    )


def p3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorded count of every page against its estimate, and the count to trust."""
    return _audited(spark, sf_dir).distinct()


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "run_id", "page_id", "clean_text", "token_count_cl100k", "primary_script")
    script = F.when(F.col("primary_script").isin(*SCRIPTS), F.col("primary_script")).otherwise("undetermined")
    return audit_pages(pages.withColumn("lang", script).drop("primary_script"), "lang")


def p3_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: documents, whether the estimated total lies within 5 % of the exact one, of those with 50 documents at least."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "language")
    docs = docs.select("doc_id", "text", catalog_language(F.col("language"), F.col("lang")).alias("language"))
    exact = token_counts(docs, "text", ["doc_id"])
    est = estimate_tokens(docs, "text", "language", ["doc_id", "language"], "doc_id").select("doc_id", "language", "est_tokens")
    each = est.join(exact, "doc_id").groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.sum("est_tokens").alias("e"), F.sum("n_tokens").alias("t"))
    return each.filter("documents >= 50").select("language", "documents", (F.abs(F.col("e") / F.col("t") - 1) <= 0.05).alias("within"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose recorded count is unusable."""
    return _audited(spark, sf_dir).filter("not usable").select("run_id", "page_id").distinct()


P3_FOUND_SQL = r"""
WITH w AS (
  SELECT run_id, page_id, token_count_cl100k AS n,
         len(regexp_extract_all(coalesce(clean_text, ''), '[^\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS words
  FROM pages)
SELECT DISTINCT run_id, page_id FROM w
WHERE words >= 20 AND (n IS NULL OR n <= 0 OR n > 5 * (words * 13 // 10) OR n * 5 < words * 13 // 10)
"""

P3_ACCURACY_SQL = f"""
SELECT language, count(*) AS documents, true AS within
FROM (SELECT coalesce({language_sql("string_split_regex(language, '[,;/]')[1]")}, {language_sql("lang")}, 'und') AS language FROM documents) GROUP BY language HAVING count(*) >= 50"""
