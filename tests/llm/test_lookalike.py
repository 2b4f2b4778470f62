"""One form for what looks the same, another for what looks different."""

import random
import unicodedata
from itertools import combinations

import pytest

from pagewright.llm import glyphs
from pagewright.llm import lookalike as A

FIELDS = "page_id string, clean_text string, form string, look string"


def spoil(t, rng):
    """A text that looks the same."""
    out = []
    back = {b: a for a, b in {**glyphs.CYRILLIC, **glyphs.GREEK}.items()}
    for ch in t:
        k = rng.random()
        if ch == " " and k < 0.2:
            ch = rng.choice("\xa0    　")
        elif ch in back and k < 0.1:
            ch = back[ch]
        elif ch.isascii() and ch.isalnum() and k < 0.2:
            ch = chr(ord(ch) + 0xFEE0)
        elif ch.isascii() and ch.islower() and k < 0.25:
            ch = chr(0x1D5BA + ord(ch) - 97)
        elif k < 0.35:
            ch = unicodedata.normalize("NFD", ch)
        if rng.random() < 0.05 and ch != "\n":
            ch += rng.choice("​⁠‍﻿")
        out.append(ch)
    return "".join(out)


BASE = "Çarşıda güzel bir gün, 1897 yılında;\nyağmur sonra éléve ve كتاب ḳānūn okundu -i harmanda.\n" * 4


def test_what_looks_the_same_becomes_equal():
    rng = random.Random(1)
    for vocabulary in ([], [(w, 50) for w in BASE.split()]):
        canon = A.Canon(vocabulary)
        for _ in range(30):
            assert canon.text(spoil(BASE, rng)) == canon.text(BASE)
        assert canon.text(BASE) == BASE.rstrip(" ") and canon.text("") == ""


@pytest.mark.parametrize("a,b", [("é", "è"), ("o", "ö"), ("1", "7"), ("n", "ñ"), ("ş", "s"), ("a", "A"), ("\n", " "), ("،", ","), ("ح", "خ"), ("ı", "i"), ("-", "–"), (".", ","), ("٢", "١")])
def test_what_looks_different_stays_different(a, b):
    canon = A.Canon([(w, 50) for w in BASE.split()])
    assert canon.text(f"x{a}y z") != canon.text(f"x{b}y z")


def test_frequent_spelling_is_canonical():
    canon = A.Canon([("рос", 100), ("сор", 80)])
    # words of another alphabet keep it, and what looks like them joins them
    assert canon.text("рос сор") == "рос сор"
    assert canon.text("poc сop") == "рос сор" and canon.text("pоx") == "pox"


def test_hyphens_at_line_ends_show():
    canon = A.Canon([])
    assert canon.text("ab\xad\ncd") == "ab-\ncd" and canon.text("ab\xadcd") == "abcd" and canon.text("ab  \ncd ") == "ab\ncd"


def test_found_agrees_with_all_pairs(spark, tables):
    rng = random.Random(2)
    bases = ["".join(rng.choice("abcçdeğ ıo1 ") for _ in range(260)).strip("\n") + "x" for _ in range(6)]
    rows = []
    for k, base in enumerate(bases):
        rows.append((f"p{k}_0", base, "x", "x"))
        rows.append((f"p{k}_same", base, "x", "x"))
        for i in range(4):
            rows.append((f"p{k}_{i + 1}", spoil(base, rng), "x", "x"))
        rows.append((f"p{k}_other", base.replace("ç", "c"), "x", "x"))
    hot = "metin " * 60
    rows += [(f"hot{i}", spoil(hot, rng), "x", "x") for i in range(40)]
    dirty = rows + rows[:9] + [("null", None, "x", "x"), ("empty", "", "x", "x"), (None, bases[0], "x", "x"), ("short", "abc", "x", "x"), ("short2", "ａbc", "x", "x"), ("long", bases[0] * 300, "x", "x")]
    got = {(r.page_id_a, r.page_id_b) for r in A.p5_found(spark, tables(pages=spark.createDataFrame(dirty, FIELDS))).collect()}
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(rows, 2) if a[1] != b[1] and glyphs.seen(a[1]) == glyphs.seen(b[1])}
    assert got == want and len(want) > 100


def test_empty(spark, tables):
    d = tables(pages=spark.createDataFrame([], FIELDS))
    assert A.p5_found(spark, d).count() == 0 and A.p5_canonical(spark, d).count() == 0


@pytest.mark.parametrize("a,b", [("Ꭺ", "A"), ("ꓐ", "B"), ("ᴏ", "o"), ("Ⅳ", "IV"), ("ⅼ", "l"), ("ν", "v"), ("ρ", "p"), ("υ", "u"), ("ı\u0307", "i"), ("ﬁ", "fi"), ("І", "I")])
def test_shapes(a, b):
    assert glyphs.seen(f"x{a}y") == f"x{b}y"
    assert A.Canon([("kalem", 5)]).token(f"x{a}y") == f"x{b}y"


def test_canonical_reads_both_texts_and_keeps_every_row(spark, tables):
    rng = random.Random(3)
    line = " ".join(BASE.split())
    pages = [(f"p{i}", spoil(BASE, rng), spoil(line, rng)) for i in range(4)]
    # one page, and no page, with texts that look different; an id without texts; words that only normalized_text holds whole
    pages += [("p0", "başka bir metin", None), (None, "bir", "bir"), (None, "iki", ""), ("none", None, None)]
    pages += [(f"w{i}", "ро-\nсы", "росы") for i in range(8)] + [("w8", "", "pocы")]
    d = tables(pages=spark.createDataFrame([*pages, *pages[:6]], "page_id string, clean_text string, normalized_text string"))
    df = A.p5_canonical(spark, d)
    assert df.columns == ["page_id", "canonical_text", "canonical_normalized_text"]
    got = sorted(map(tuple, df.collect()), key=str)
    look = lambda rows: {(p, a and glyphs.seen(a), b and glyphs.seen(b)) for p, a, b in rows}
    assert len(got) == len(pages) and look(got) == look(pages)
    assert len({r[1:] for r in got if r[1] and r[1].startswith("Ça")}) == 1
    assert {r[2] for r in got if (r[0] or "").startswith("w")} == {"росы"}


@pytest.mark.parametrize("a,b", [("\u043e\u0308", "ö"), ("\u0415\u0300", "È"), ("e\u200b\u0301", "é"), ("\ufb01", "fi"), ("\u2163", "IV")])
def test_tokens_that_look_equal_have_one_form(a, b):
    spellings = [*{f"x{b.replace('i', 'і').replace('I', 'І')}y": 30, f"х{b}y": 20, f"x{b}y": 9}.items()]
    for vocabulary in ([], spellings[-1:], spellings[1:2], spellings):
        canon = A.Canon(vocabulary)
        assert canon.text(f"x{a}y") == canon.text(f"x{b}y")
