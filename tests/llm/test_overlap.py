"""Chunks, longest common subsequences, pairs across splits."""

import random
from itertools import product

import numpy as np

from pagewright.llm import overlap as O

FIELDS = "page_id string, split string, clean_text string, record string, chunks string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_words_agree_with_the_table():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert O.common_words(a, b) == lcs(a, b)


def test_chunks_cover_and_depend_on_content_alone():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 32, 400)
    digests, lengths = O.chunks_of(words)
    assert lengths.sum() == 400 and lengths.max() <= O.LONGEST and len(set(digests)) == len(digests)
    moved, _ = O.chunks_of(np.concatenate([rng.integers(0, 1 << 32, 17), words]))
    assert len(set(digests) & set(moved)) > 0.8 * len(digests)
    assert O.chunks_of(np.zeros(0, np.int64))[0].size == 0 and O.chunks_of(np.array([5]))[1].tolist() == [1]
    assert not set(O.chunks_of(words[:50])[0]) & set(O.chunks_of(words[200:250])[0])


def test_words_ignore_case_marks_lines_and_division():
    assert O.words_of("Balık-\nçı, GELDİ!\n(yağmur)  ｗｉｄｅ") == O.words_of("balıkçı geldi yağmur wide")
    assert O.words_of("") == []


def changed(words, rng, share):
    return [w if rng.random() > share else f"y{rng.randint(0, 10**6)}" for w in words]


def test_found_agrees_with_all_pairs(spark, tables):
    rng = random.Random(3)
    vocabulary = [f"kelime{i}" for i in range(400)]
    rows = []
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(40, 120))]
        for i, share in enumerate((0, 0, 0.03, 0.08, 0.12, 0.4, 0.7)):
            rows.append((f"p{k}_{i}", rng.choice(["train", "train", "test", "validation"]), " ".join(changed(base, rng, share)), "x", "x"))
        rows.append((f"p{k}_half", "train", " ".join(base[: len(base) // 2] + [rng.choice(vocabulary) for _ in range(len(base) // 2)]), "x", "x"))
    boiler = " ".join(f"ortak{i}" for i in range(12))
    rows += [(f"boiler{i}", "train" if i % 2 else "test", boiler + " " + " ".join(rng.choice(vocabulary) for _ in range(60)), "x", "x") for i in range(80)]
    rows += [(f"copy{i}", "train" if i % 3 else "test", " ".join(f"aynı{j}" for j in range(50)), "x", "x") for i in range(60)]
    dirty = rows + rows[:11] + [("null", "test", None, "x", "x"), ("empty", "train", "", "x", "x"), (None, "test", rows[0][2], "x", "x"), ("nosplit", None, rows[0][2], "x", "x"), ("short", "test", "abc", "x", "x"), ("word", "test", "w" * 5000, "x", "x"), ("long", "test", " ".join(rng.choice(vocabulary) for _ in range(20_000)), "x", "x")]
    frame = spark.createDataFrame(dirty, FIELDS)
    got = {(r.page_id_a, r.page_id_b) for r in O.p6_found(spark, tables(pages=frame, documents=spark.createDataFrame([("p", "s")], "document_id string, source string"))).collect()}
    words = {r[0]: O.words_of(r[2]) for r in rows}
    train, rest = ([r for r in rows if (r[1] == "train") == t] for t in (True, False))
    want = {tuple(sorted((a[0], b[0]))) for a, b in product(train, rest) if len(a[2]) >= 200 and len(b[2]) >= 200 and 5 * lcs(words[a[0]], words[b[0]]) >= 4 * max(len(words[a[0]]), len(words[b[0]]))}
    assert got == want and len(want) > 700


def test_evenly_spread_changes_are_found(spark, tables):
    rng = random.Random(5)
    rows, want = [], set()
    for k in range(60):
        n = rng.randint(40, 160)
        base = [f"w{k}x{i}" if rng.random() < 0.5 else f"oft{rng.randint(0, 50)}" for i in range(n)]
        other = list(base)
        step = 5 if k % 3 else 6
        for i in range(k % 5 % step, n, step):
            other[i] = f"neu{k}x{i}"
        if k % 4 == 0:  # left out instead, on differing places of both
            base = [w for i, w in enumerate(base) if i % 12 != 3]
            other = [w for i, w in enumerate(other) if i % 12 != 9]
        rows += [(f"a{k}", "train", " ".join(base), "x", "x"), (f"b{k}", "test", " ".join(other), "x", "x")]
        if 5 * lcs(base, other) >= 4 * max(len(base), len(other)):
            want.add((f"a{k}", f"b{k}"))
    assert len(want) > 30
    frame = spark.createDataFrame(rows, FIELDS)
    d = tables(pages=frame, documents=spark.createDataFrame([("p", "s")], "document_id string, source string"))
    long = {r[0] for r in rows if len(r[2]) >= 200}
    assert {(r.page_id_a, r.page_id_b) for r in O.p6_found(spark, d).collect()} == {w for w in want if set(w) <= long}


def test_report_counts(spark, tables):
    text = " ".join(f"söz{i}" for i in range(60))
    rows = [("a_page_0001", "train", text, "x", "x"), ("b_page_0001", "test", text, "x", "x"), ("c_page_0001", "test", " ".join(f"başka{i}" for i in range(60)), "x", "x")]
    d = tables(pages=spark.createDataFrame(rows + rows, FIELDS), documents=spark.createDataFrame([("a", "S1"), ("b", "s2 "), ("b", "s2 ")], "document_id string, source string"))
    got = {(r.split, r.source): (r.pages, r.overlapping, r.mean_fraction) for r in O.p6_report(spark, d).collect()}
    assert got == {("train", "s1"): (1, 1, 1.0), ("test", "s2"): (1, 1, 1.0), ("test", "unknown"): (1, 0, 0.0)}


def test_empty(spark, tables):
    d = tables(pages=spark.createDataFrame([], FIELDS), documents=spark.createDataFrame([], "document_id string, source string"))
    assert O.p6_found(spark, d).count() == 0 and O.p6_report(spark, d).count() == 0
