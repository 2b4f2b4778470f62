"""Cleaning, normalizing, quality and script rules against cases and a plain re-statement of the rules."""

import html
import re
import unicodedata
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.functions import clean as C
from pagewright.functions import labels as L
from pagewright.functions import script as S
from pagewright.functions.classes import SPACE
from pagewright.functions.quality import repeated_unit, with_quality


def run(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[1] for r in sorted(rows.select("i", f(F.col("t"))).collect())]


CLEAN = [
    ("étude", "étude"),
    ("<|ref|>müs- tahfaza<|/ref|><|det|>[[1, 2, 3, 4]]<|/det|>\nmetin müs- tahfaza", "metin müs- tahfaza"),
    ("<|ref|>başlık<|/ref|>[[10, 20]] son", "başlık son"),
    ("<table><tr><td>a</td><td><b>b</b> x</td></tr><tr><th>c</th><td>d&amp;</td></tr></table>", "a | <b>b</b> x\nc | d&"),
    ("&quot;söz&#x27; &copy;", "\"söz' ©"),
    ("bir\n\n\n\n\niki  \nüç\t", "bir\n\niki\nüç"),
    ("kesin-\nlikle ve kesin- \nlikle", "kesinlikle ve kesinlikle"),
    ("“a” ‘b’ ﬁn ﬂu كـتاب", "\"a\" 'b' fin flu كتاب"),
    ("<|im_start|>x<|weird_one|>\x00y", "xy"),
    ("bir<br/>iki<p>üç</p>dört", "bir\nikiüç\ndört".replace("ikiüç", "ikiüç")),
    ("", ""),
    (None, ""),
]


def test_clean_cases(spark):
    got = run(spark, C.clean, *[a for a, _ in CLEAN])
    assert got == [b for _, b in CLEAN]


def test_fidelity_keeps_layout(spark):
    texts = ["a\n\n\nb<|det|>\x00  ", "<|ref|>k<|/ref|><|det|>[[1,2]]<|/det|> z", None, ""]
    assert run(spark, C.clean_fidelity, *texts)[0] == "a\n\n\nb"
    assert run(spark, lambda c: C.clean_fidelity(c, True), *texts) == ["a\n\n\nb", "z", "", ""]


def test_normalize_cases(spark):
    got = run(spark, C.normalize, "müba-\ndelesi", "<center>a</center>  b\n\nc", "söz-  cük 12-\n13", None, "")
    assert got == ["mübadelesi", "a b c", "sözcük 12- 13", "", ""]


TABLES = [
    ("a<table x><tr><td>1</td><th> <b>2</b>  &amp; </th><td></td></tr><tr></tr><TR><td>q</td></TR></table>z", "a1 | <b>2</b> &\nqz"),
    ("<table><tr><td>p<br>q</td></tr></table> <table></table>", "pq "), ("<table><tr><td>never closed", "<table><tr><td>never closed"), ("<tr><td>x</td></tr>", "<tr><td>x</td></tr>"),
    ("<table><tr><td>a<tr><td>b</td></tr></table>", "ab"), ("<table><td>no row</td><tr><td>k</tr><tr><td>m</td></tr></table>", "m"), ("<table><tr><td>a</th><td>b</td></tr></table>", "a | b"), ("x</table>y", "x</table>y"),
    ("<table>\n<tr>\n<td>bir\niki</td>\n</tr>\n</table>\n<TABLE><tr><td>ş</td></tr></TABLE>", "bir iki\nş"), ("<tablet><tr><td>q</td></tr></table>", "<tablet><tr><td>q</td></tr></table>"),
]


def test_tables():
    assert [C.table_lines(a) for a, _ in TABLES] == [b for _, b in TABLES]


def plain_tables(t):
    """Tables told by cutting a text at their tags, again and again."""
    low, out = t.lower(), ""
    while True:
        m = re.search(r"<table\b[^>]*>", low)
        end = low.find("</table>", m.end()) if m else -1
        if end < 0:
            return out + t
        body, rows = t[m.start() : end], []
        for row in between(body, "tr"):
            cells = [" ".join(html.unescape(re.sub(rf"(?i)</?(?:{C.CLEAN_TAGS})\b[^>]*>", "", c)).split()) for c in between(row, "t[dh]")]
            rows.append(" | ".join(c for c in cells if c))
        out += t[: m.start()] + "\n".join(r for r in rows if r)
        t, low = t[end + 8 :], low[end + 8 :]


def between(text, tag):
    at = 0
    while (m := re.compile(rf"(?i)<{tag}\b[^>]*>").search(text, at)) and (e := re.compile(rf"(?i)</{tag}>").search(text, m.end())):
        yield text[m.end() : e.start()]
        at = e.end()


def plain_clean(t):
    """The cleaning rules said again in plain Python."""
    sp = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
    t = unicodedata.normalize("NFC", t)
    t = re.sub(rf"(?s)<\|ref\|>.*?<\|/ref\|>{sp}*<\|det\|>{sp}*\[\[.*?\]\]{sp}*<\|/det\|>{sp}*", "", t)
    t = re.sub(rf"(?s)<\|ref\|>(.*?)<\|/ref\|>{sp}*\[\[[\d\s,]+\]\]", r"\1", t)
    for x in C.MODEL_TOKENS:
        t = t.replace(x, "")
    t = re.sub(r"<\|/?[a-z_]+\|>|\x00", "", t)
    t = plain_tables(t)
    t = re.sub(rf"(?i)<br{sp}*/?>|</(?:p|div|h[1-6]){sp}*>", "\n", t)
    t = html.unescape(re.sub(rf"(?i)</?(?:{C.CLEAN_TAGS})\b[^>]*>", "", t))
    t = re.sub(r"([^\W])- ?\n([^\W])", r"\1\2", t)
    t = "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", t).split("\n"))
    for a, b in C.MISPRINTS:
        t = t.replace(a, b)
    return t.strip()


PIECES = st.sampled_from(["ab", "ç", "12", "- \n", "-\n", "\n", "\n\n\n", " ", "\t", "<br>", "</p>", "<td>", "<table><tr><td>q</td></tr></table>", "&amp;", "&lt;", "<|det|>", "<|ref|>", "<|/ref|>", "[[1,2]]", "<|/det|>", "“", "ﬁ", "ـ", "é", "\xa0", "كتاب"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=40))
def test_clean_agrees_with_plain_rules(spark, texts):
    assert run(spark, C.clean, *texts) == [plain_clean(t) for t in texts]


def quality(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return [r.quality for r in with_quality(df, "t", "n").orderBy("n").collect()]


LINES = ["Birinci satır burada durur.", "İkinci satır ondan sonra gelir.", "Üçüncü satır en sonda kalır."]


def test_quality_statuses(spark):
    q = quality(
        spark, "", "hello", "   \n ", "\n".join(LINES), "\n".join(["aynı satır"] * 14 + [f"satır {i}" for i in range(6)]), "\n".join(["aynı satır"] * 10 + [f"başka satır {i}" for i in range(12)]),
        "\n".join(["tekrar"] * 6 + [f"ayrı satır {i}" for i in range(20)]), "a" * 100 + "bcdefghijk" * 3 + "bcdef", "<|det|>" * 4 + " metin devam ediyor burada", "<|grounding|>" * 3 + " metin devam ediyor burada",
        "uzunca bir keli-\nme burada duruyor", "<center>ortalanmış bir satır</center>", None, "..............." + "abcdefghijklmnopqrst",
    )
    assert [x.status for x in q] == ["empty", "empty", "empty", "pass", "fail", "warn", "warn", "fail", "fail", "fail", "warn", "warn", "empty", "fail"]
    assert q[0].issues == ["Page 0: output too short (0 chars)"] and q[0].total_lines is None
    assert q[4].issues[0].startswith("Page 4: extreme repetition (65%")
    assert q[5].issues[0].startswith("Page 5: moderate repetition (41%")
    assert "6 consecutive identical lines" in q[6].issues[0]
    assert q[10].flags == ["line_hyphenation"] and q[11].flags == ["markup_leak"]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["aa", "b c", "", "uzun bir satır", "\t x", "ç"]), max_size=30).map("\n".join), min_size=15, max_size=30))
def test_quality_metrics_agree_with_plain_counts(spark, texts):
    for t, q in zip(texts, quality(spark, *texts)):
        s = t.strip()
        assert q.text_length == len(s)
        if len(s) < 20:
            assert q.status == "empty"
            continue
        lines = [x.strip() for x in s.split("\n") if x.strip()]
        run_, best = 0, 0
        for i, x in enumerate(lines):
            run_ = run_ + 1 if i and lines[i - 1] == x else 1
            best = max(best, run_)
        top = Counter(s.replace(" ", "").replace("\n", "")).most_common(1)[0]
        assert (q.total_lines, q.unique_lines, q.max_consecutive_dupes) == (len(lines), len(set(lines)), best)
        assert (q.dominant_char, q.dominant_char_count) == top


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab \n", max_size=5), st.text("ab. \t\n", min_size=1, max_size=4), st.integers(8, 13), st.text("ab ", max_size=4)), min_size=30, max_size=60))
def test_repeated_units_agree_with_the_single_pattern(spark, parts):
    texts = [a + unit * n + b for a, unit, n, b in parts]
    assert run(spark, repeated_unit, *texts) == [bool(re.search(r"(\S+\s*){1}\1{10,}", t)) for t in texts]


def scripts(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string").withColumn("c", S.script_counts("t"))
    return [r.a for r in df.withColumn("a", S.analysis(F.col("t"), F.col("c"))).orderBy("n").collect()]


def test_script_cases(spark):
    a = scripts(spark, "", None, "  \n", "This is plain English text.", "هذا نص عربي طويل بما يكفي للاختبار والقراءة والكتابة", "نص عربي English words here نص آخر", "Çarşıda güzel bir gün", "ḳānūn-i cedīde ḥükūmet ṭarafından", "12 34")
    assert [x.direction for x in a] == ["undetermined"] * 3 + ["ltr", "rtl", "mixed", "ltr", "ltr", "undetermined"]
    assert [x.primary_script for x in a] == ["undetermined"] * 3 + ["latin", "arabic", "mixed", "latin", "latin_extended", "undetermined"]
    assert a[6].detected_languages == ["tr", "ota-latn"] and a[3].detected_languages == []
    assert a[4].sample_rtl_chars == "هذانص" and a[3].sample_ltr_chars == "Thisi"


def test_blocks(spark):
    assert run(spark, S.blocks, "a\n\n \n\n b \n\nc", None, "") == [["a", "b", "c"], [], []]


def test_splits_and_names(spark):
    assert set(run(spark, L.hash_split, *[str(i) for i in range(300)])) == {"train", "validation", "test"}
    assert run(spark, lambda c: L.file_stem(c, F.lit("0123456789abcdef")), "Türk'ün  Kitabı.", "...", "") == ["Türk_ün_Kitabı__01234567", "document__01234567", "document__01234567"]
    assert run(spark, L.artifact_stem, "a b.pdf", "klasör/x-1.y.PDF", ".pdf") == ["a_b", "x-1.y", ".pdf"]
    assert run(spark, L.language_list, " tr, ,en ", None, "") == [["tr", "en"], [], []]
    assert run(spark, L.json_list, '["a", 1]', "a, b", '{"a": 1}', "", None, "[]") == [["a", "1"], ["a", "b"], [], [], [], []]
    assert run(spark, lambda c: L.size_bucket(c.cast("long")), "0", "999", "1000", "2000000") == ["n<1K", "n<1K", "1K<n<10K", "1M<n<10M"]


def test_page_id_pads(spark):
    assert spark.range(1).select(L.page_id(F.lit("d"), F.lit(7))).first()[0] == "d_page_0007"


def test_white_space_is_that_of_split(spark):
    points = [cp for cp in range(0x10000) if not 0xD800 <= cp < 0xE000]
    got = spark.createDataFrame([(cp, chr(cp)) for cp in points], "n int, t string").filter(F.col("t").rlike(SPACE)).select("n").collect()
    assert {r.n for r in got} == {cp for cp in points if chr(cp).isspace()}


def test_word_classes_follow_unicode(spark):
    from pagewright.functions.fold import word_count

    texts = ["a b c​d", " x ", "", None, "\x1cy\x1dz"]
    assert run(spark, word_count, *texts) == [len((t or "").split()) for t in texts]
