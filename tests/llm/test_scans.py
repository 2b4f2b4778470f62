"""Divided words, misread words, running titles, page numbers, repair."""

import random

import pytest

from pagewright.llm import scans as S
from pagewright.llm.trie import Trie, levenshtein_edits, weighted

FIELDS = "page_id string, document_id string, raw_text string, defect string"
BOOKS = "document_id string, display_title string, pdf_title string, work string, author string, filename string, line_hyphen string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def test_automaton_finds_every_word_within_the_bound():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(200)})
    trie = Trie((w, 1) for w in words)
    edits = levenshtein_edits()
    for _ in range(40):
        token = "".join(rng.choice("abcde") for _ in range(rng.randint(0, 6)))
        for bound in (0, 1, 2):
            got = {trie.words[k]: c for k, c in weighted(trie, token, edits, bound).items()}
            assert got == {w: distance(token, w) for w in words if distance(token, w) <= bound}


def test_trie_children_and_words():
    trie = Trie([("a", 1), ("ab", 2), ("b", 3), ("abc", 4)])
    assert [c for c, _ in trie.children(trie.root())] == ["a", "b"]
    assert [c for c, _ in trie.children(trie.step(trie.root(), "a"))] == ["b"]
    assert trie.word_at(trie.walk(trie.root(), "ab")) == trie.words.index("ab") and trie.step(trie.root(), "z") is None


def test_confusions_are_found_as_brute_force_finds_them():
    words = ["deneme", "kalem", "odun", "nehir", "masa"]
    trie = Trie((w, 9) for w in words)

    def spoiled(w, k):
        if k == 0:
            return {w}
        out = set()
        for i, ch in enumerate(w):
            for o in S.CONFUSIONS.get(ch, ()):
                out |= {w[:i] + o + rest for rest in spoiled(w[i + 1 :], k - 1)}
        return out

    for w in words:
        for k in (1, 2):
            for token in spoiled(w, k):
                assert w in {trie.words[x] for x in weighted(trie, token, S.confusion_edits, S.BOUND)}


@pytest.mark.parametrize("line,expected", [("12", True), ("— ٣٨ —", True), ("Sayfa 7", True), ("s. 7", True), ("xiv", True), ("[41]", True), ("1912 yılında geldi.", False), ("dil", False), ("", False), ("- - -", False), ("صفحة ٣٨", True), ("kalem", False)])
def test_page_number_lines(line, expected):
    assert S.is_page_number(line) is expected


def test_headers():
    names = S.names_of(["Unutulan Kule, Vol. 2"], ["Kule, Zühre"], "Unutulan_Kule_12.pdf")
    for line in ("UNUTULAN KULE", "U N U T U L A N   K U L E", "~ Unutulan Kule ~", "12  Unutulan Kule", "Zühre Kule / Unutulan Kule", "ZÜHRE KULE", "Unutu1an Kule"):
        assert S.repeats_name(line, names) or S.styled(line), line
    for line in ("BİRİNCİ BÖLÜM", "Unutulan kule o gün çok kalabalıktı ve herkes oradaydı.", "12"):
        assert not (S.repeats_name(line, names) or S.styled(line)), line


def page(turkish, rng, n=60):
    out = []
    for i in range(n):
        out.append(rng.choice(turkish))
    text = " ".join(out)
    return "\n".join(text[i : i + 60].strip() for i in range(0, len(text), 60)).replace("\n\n", "\n")


def lines_of(turkish, rng, rows=12, width=8):
    return [" ".join(rng.choice(turkish) for _ in range(width)) for _ in range(rows)]


@pytest.fixture
def corpus(spark, tables, turkish):
    rng = random.Random(4)
    rows, books = [], []
    for k in range(40):
        rows.append((f"plain_{k}", f"d{k}", "\n".join(lines_of(turkish, rng)) + ".", "x"))
        books.append((f"d{k}", f"Kitap {k} Adı", None, None, "Ali Veli", f"Kitap_{k}.pdf", "x"))
    body = lines_of(turkish, rng)
    rows += [
        ("hyphen", "d0", "\n".join(body[:3]) + "\nbalık-\nçı denizde " + "\n".join(body[3:]) + ".", "x"), ("soft", "d0", "\n".join(body[:3]) + "\nbalık¬\nçı denizde.\n" + "\n".join(body[3:]) + ".", "x"),
        ("range", "d0", "\n".join(body[:3]) + "\n1789-\n1794 yılları.\n" + "\n".join(body[3:]) + ".", "x"), ("misread", "d1", "\n".join(body[:3]) + "\nyağrnur ve def†er.\n" + "\n".join(body[3:]) + ".", "x"),
        ("header", "d2", "KİTAP 2 ADI\n" + "\n".join(body) + ".", "x"), ("author", "d3", "\n".join(body) + ".\nAli Veli", "x"), ("chapter", "d4", "BİRİNCİ BÖLÜM\n" + "\n".join(body) + ".", "x"),
        ("number", "d5", "\n".join(body) + ".\n— 17 —", "x"), ("inside", "d5", "\n".join(body[:5]) + ".\n1815\n" + "\n".join(body[5:]) + ".", "x"), ("both", "d6", "Kitap 6 Adı    12\n" + "\n".join(body) + ".", "x"),
        ("both", "d6", "Kitap 6 Adı    12\n" + "\n".join(body) + ".", "x"), ("empty", "d7", "", "x"), ("null", "d7", None, "x"), (None, "d7", "kayıp", "x"), ("lost", None, "\n".join(body) + ".", "x"), ("long", "d8", " ".join(rng.choice(turkish) for _ in range(20_000)), "x"),
        ("word", "d8", "a" * 50_000, "x"),
    ]
    return tables(pages=spark.createDataFrame(rows, FIELDS), documents=spark.createDataFrame(books + books[:3], BOOKS))


def test_found(spark, corpus):
    got = {}
    rows = S.p1_found(spark, corpus).collect()
    for r in rows:
        got.setdefault(r.page_id, set()).add(r.defect)
    assert len(rows) == len(set(rows))
    assert got == {"hyphen": {"line_hyphen"}, "soft": {"line_hyphen"}, "misread": {"misread"}, "header": {"running_header"}, "author": {"running_header"}, "number": {"page_number"}, "both": {"running_header", "page_number"}}


def test_found_on_no_pages(spark, tables):
    d = tables(pages=spark.createDataFrame([], FIELDS), documents=spark.createDataFrame([], BOOKS))
    assert S.p1_found(spark, d).count() == 0


def test_repair():
    words = S.Words([(w, 100) for w in ("balıkçı", "yağmur", "geldi", "ber-vech", "defter")], floor=1)
    mends = {"yağrnur": "yağmur", "def†er": "defter"}
    text, joined, repaired = S.repair("BAŞLIK\nbalık-\nçı yağrnur\ngeldi ber-\nvech. Def†er\n\n   geldi\n12", [0, -1], words, mends)
    assert text == "balıkçı yağmur geldi ber-vech. Defter\n\ngeldi" and (joined, repaired) == (1, 2)
    assert S.repair("", [], words) == ("", 0, 0)


def test_frequent_misreading_is_no_word(spark, tables):
    text = " ".join(["yağmur"] * 1000 + ["yağrnur"] * 9 + ["cümle"] * 30 + ["eümle"] * 29 + ["ad_soyad"] * 8)
    words, _, _, found = S.vocabulary(spark.createDataFrame([(text,)], "raw_text string"))
    assert "yağrnur" not in words.known and {"yağmur", "cümle", "eümle"} <= set(words.known)
    assert words.told == {"yağrnur": "yağmur", "ad_soyad": None} and {r.token for r in found.collect()} == {"yağrnur"}


def test_candidates_are_complete():
    """All words within the bound come out, whatever the edit; brute force over the vocabulary."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aeiklmnrt") for _ in range(rng.randint(2, 9))) for _ in range(400)})
    lexicon = S.Lexicon({w: (50, w) for w in words})
    for w in rng.sample(words, 60):
        i = rng.randrange(len(w))
        token = rng.choice([w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "z" + w[i + 1 :]])
        got = {x for x, _ in lexicon.near(token)}
        want = {x for x in words if x != token and distance(token, x) == 1 and len(token) >= S.ONE_PLAIN}
        assert want <= got, (token, want - got)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_edits_outside_the_table_are_found(spark, tables, turkish, seed):
    rng = random.Random(seed)
    rows, spoiled = [], set()
    confusable = set(S.CONFUSIONS) | {o for outs in S.CONFUSIONS.values() for o in outs}
    for k in range(300):
        lines = [" ".join(rng.choice(turkish) for _ in range(8)) for _ in range(12)]
        if k % 2:
            row, at = rng.randrange(4, 8), rng.randrange(1, 7)
            words = lines[row].split()
            w = words[at]
            while True:
                i, ch = rng.randrange(len(w)), rng.choice([x for x in "cfjvyzpxğ" if x not in confusable])
                made = rng.choice([w[:i] + ch + w[i:], w[:i] + w[i + 1 :], w[:i] + ch + w[i + 1 :]])
                if len(made) >= S.ONE_PLAIN and made not in turkish:
                    break
            words[at] = made
            lines[row] = " ".join(words)
            spoiled.add(f"p{k}")
        rows.append((f"p{k}", f"d{k}", "\n".join(lines) + ".", "x"))
    d = tables(pages=spark.createDataFrame(rows, FIELDS), documents=spark.createDataFrame([], BOOKS))
    got = {r.page_id for r in S.p1_found(spark, d).collect() if r.defect == "misread"}
    assert len(got & spoiled) >= 0.9 * len(spoiled) and len(got - spoiled) <= 0.02 * len(rows)


def test_pages_come_out_as_they_were_written(spark, tables, turkish):
    rng = random.Random(9)
    rows, wanted = [], {}
    for k in range(120):
        paragraphs = [" ".join(rng.choice(turkish) for _ in range(40)).capitalize() + "." for _ in range(2)]
        wanted[f"p{k}"] = "\n\n".join(paragraphs)
        printed = []
        for p in paragraphs:
            lines, line = [], ""
            for w in p.split(" "):
                if len(line) + len(w) > 50:
                    if len(w) > 5 and w.isalpha():
                        line, w = f"{line} {w[:3]}-", w[3:]
                    lines, line = [*lines, line], w
                else:
                    line = f"{line} {w}".strip()
            printed.append("\n".join([*lines, line]))
        body = "\n\n".join(printed)
        if k % 20 == 0:
            body = body.replace("yağmur", "yağrnur", 1).replace(" defter ", " def†er ", 1)
        rows.append((f"p{k}", "d", f"KİTAP ADI\n{body}\n— {k + 1} —", "x"))
    d = tables(pages=spark.createDataFrame(rows, FIELDS), documents=spark.createDataFrame([("d", "Kitap Adı", None, None, "Ali Veli", "k.pdf", "x")], BOOKS))
    got = {r.page_id: r.text for r in S.p1_pages(spark, d).collect()}
    bad = [(k, got.get(k), wanted[k]) for k in wanted if got.get(k) != wanted[k]]
    assert got.keys() == wanted.keys() and len(bad) <= 0.02 * len(wanted), bad[:2]


def test_sources_are_all_the_automaton_reaches():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("einrmcldhuko") for _ in range(rng.randint(2, 5))) for _ in range(3000)})
    trie = Trie((w, 1) for w in words)
    for token in rng.sample(words, 40) + ["ba1ıkçı".replace("ı", "i"), "yagrnnur"]:
        reached = {trie.words[k] for k, c in weighted(trie, token, S.confusion_edits, S.BOUND).items() if c} - {token}
        assert reached == S.sources_of(token) & set(words)


def test_misreading_of_a_rare_word_is_found(spark, tables, turkish):
    rng = random.Random(6)
    rows = [(f"p{i}", "d", "\n".join(lines_of(turkish, rng)) + ("\nzümrüdüanka geldi." if i < 5 else "\ngemi."), "x") for i in range(40)]
    rows += [("wrong", "d", rows[9][2] + "\nve züinrüdüanka ile zürnrüdüanka geldi.\n" + rows[8][2], "x"), ("other", "d", rows[9][2] + "\nzümrütoğlu geldi.\n" + rows[8][2], "x")]
    d = tables(pages=spark.createDataFrame(rows, FIELDS), documents=spark.createDataFrame([("d", "Kitap Adı", None, None, "Ali Veli", "k.pdf", "x")], BOOKS).selectExpr("*", "1L AS doc_id", "'tr' AS language", "'' AS text"))
    assert {r.page_id for r in S.p1_found(spark, d).collect() if r.defect == "misread"} == {"wrong"}
    notes, _, words, mends = S._notes(spark, d)
    held = {r.page_id: {m.token: m.word for m in r.mends} for r in mends.collect()}
    assert held == {"wrong": {"zürnrüdüanka": "zümrüdüanka"}}
    assert "ile zümrüdüanka geldi." in S.repair(rows[-2][2], [], words, held["wrong"])[0]
    # a vocabulary without the word leaves it to the counts of all tokens
    words.known.pop("zümrüdüanka")
    _, counts, pairs, _ = S.vocabulary(spark.read.parquet(d + "/pages.parquet"))
    found = S.candidates(counts, words)
    assert not found.filter("token = 'zürnrüdüanka'").count()
    again = S.mends_of(S.page_notes(spark.read.parquet(d + "/pages.parquet"), words, 30), counts, pairs, found)
    assert {r.page_id: [m.word for m in r.mends if m.token == "zürnrüdüanka"] for r in again.collect()}["wrong"] == ["zümrüdüanka"]


def test_long_lines_at_the_edge_are_compared_with_the_names():
    names = S.names_of(["Pek Uzun Bir Kitap Adı ve Onun Altında Duran İkinci Başlık"], ["Ali Veli"], None)
    line = " ".join("PEK UZUN BİR KİTAP ADI VE ONUN ALTINDA DURAN İKİNCİ BAŞLIK")
    assert len(line) > 90 and S.may_name(line, 60) and S.repeats_name(line, names)
    assert not S.may_name("uzun bir satır " * 40, 60)
