"""Counts of characters, exact tokens, the regression and the audit of recorded counts."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import charstats, tokens

PAGES = "run_id string, page_id string, clean_text string, token_count_cl100k long, primary_script string, est_tokens string, n_words string"


def plain(t):
    t = t or ""
    kinds = [charstats.class_table()[min(ord(c), 0x10000)] for c in t]
    return [len(t.encode()), len(t), len(t.split()), *[kinds.count(k) for k in (2, 3, 4, 5, 6, 7)]]


def test_character_counts_agree_with_a_loop():
    rng = random.Random(1)
    letters = "abcç ığ\n\t 12٣.,—«كتاب  x𝖺é"
    texts = [None, "", " ", "a", *["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(60)]]
    for part in (pa.array(texts, pa.string()), pa.array(["zzz", *texts], pa.string())[1:], pa.array([], pa.string())):
        got = charstats.counts(part)
        assert got.tolist() == [plain(t) for t in part.to_pylist()]


def test_classes():
    table = charstats.class_table()
    assert table[ord(" ")] == table[0xA0] == charstats.SPACE and table[ord("٣")] == charstats.DIGIT and table[ord("ş")] == charstats.LATIN_EXT
    assert all(table[cp] == charstats.SPACE for cp in range(0x3100) if chr(cp).isspace()) and unicodedata.category("—") == "Pd" and table[ord("—")] == charstats.PUNCT


def test_exact_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id long, t string")
    got = {r.id: r.n_tokens for r in tokens.token_counts(df, "t", ["id"]).collect()}
    enc = tokens.encoder(tokens.TOKENIZER)
    ids = enc.encode_ordinary("hello world")
    assert got[2] == got[3] == 0 and got[1] == len(ids) and enc.decode(ids) == "hello world" and got[4] > 1


def test_estimates_are_close_on_texts_not_seen(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").withColumn("l", tokens.catalog_language(F.col("language"), F.col("lang")))
    est = tokens.estimate_tokens(docs.select("doc_id", "text", "l"), "text", "l", ["doc_id", "l"], "doc_id")
    true = tokens.token_counts(docs, "text", ["doc_id"])
    rows = est.join(true, "doc_id").select("est_tokens", "n_tokens").collect()
    a, b = sum(r.est_tokens for r in rows), sum(r.n_tokens for r in rows)
    assert len(rows) == docs.count() and abs(a - b) < 0.05 * b
    assert np.median([abs(r.est_tokens - r.n_tokens) / max(r.n_tokens, 1) for r in rows]) < 0.2


def test_fit_corrects_the_bias_of_its_holdout():
    rng = np.random.default_rng(1)
    x = rng.integers(1, 500, (400, len(charstats.FEATURES)))
    y = x @ np.arange(1, len(charstats.FEATURES) + 1)
    rows = [("tr", *map(int, r), int(t) * (2 if held else 1), held) for r, t, held in zip(x, y, [False, True] * 200)]
    beta = np.array(tokens.fit(rows)["tr"])
    assert np.allclose(x @ beta, 2 * y, rtol=0.05)
    assert tokens.fit([])[""] == [0.0] * len(charstats.FEATURES)


def test_found_follows_the_rule(spark, tables):
    text = "kelime " * 30
    rows = [("r", f"p{n}", text, n, "latin", "x", "x") for n in (None, 0, -1, 1, 7, 8, 39, 195, 196, 10**9)]
    rows += [("r", "short", "kelime " * 19, None, None, "x", "x"), ("r", "null", None, None, None, "x", "x"), ("r", "empty", "", 0, "", "x", "x"), ("r", "twenty", "ab " * 20, None, None, "x", "x")]
    d = tables(pages=spark.createDataFrame(rows + rows[:4], PAGES))
    got = [r.page_id for r in tokens.p3_found(spark, d).collect()]
    assert sorted(got) == sorted(["pNone", "p0", "p-1", "p1", "p7", "p196", "p1000000000", "twenty"])


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None)]])
def test_empty_and_null_tables(spark, tables, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string, group_path string")
    d = tables(pages=spark.createDataFrame([], PAGES), documents=docs)
    assert tokens.p3_found(spark, d).count() == 0
    assert tokens.p3_tokens(spark, d).count() == len(rows)
    assert {r.tokens for r in tokens.p3_budget(spark, d).collect()} <= {0}


def test_budget_adds_up(spark, small):
    rows = tokens.p3_budget(spark, small).collect()
    total = {k: sum(r.tokens for r in rows if r.kind == k) for k in ("source", "language", "domain", "all")}
    assert len(set(total.values())) == 1 and total["all"] > 0
