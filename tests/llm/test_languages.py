"""Label spellings, paragraphs, held-out accuracy, mixed documents."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import languages as G
from pagewright.llm.inputs import language_set

ALPHABETS = {
    "tr": "ağaç çiçek böyle güneşli yağmurdan öğretmenler kitapların şehirde bulundu geçmişti kapısını",
    "ota-latn": "ḳānūn-i maʿārif ḥükūmetiñ muʿāhede olunmuşdur ḫāliṣ eyledi taḥrīr vilāyete ṣanʿatiñ idüb",
    "en": "which their harbour with these morning described the letters shown through windows",
    "fr": "lorsque cette bibliothèque était des lettres après écrivit fenêtres montagnes passait",
    "de": "welche diese Straße schrieb nicht Fenster größer wurde Bücher zwischen Schüler",
    "ar": "كانت المدرسة القديمة على الطريق الطويل والكتاب الجديد ذهبت إلى القرية البعيدة",
    "ota": "ایله حکومتنك معارفدن اولنمشدر ولایتلر ایدوب کتابلرك چوق تذکرهده قیلندی گبی",
}
FIELDS = "doc_id long, language string, text string, n_chars long, source string, filename string, display_title string, pdf_title string, work string, words string, letters int"


def paragraph(code, rng, n=24):
    return " ".join(rng.choice(ALPHABETS[code].split()) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(c, paragraph(c, rng)) for c in ALPHABETS for _ in range(25)]
    wrong = [(rng.choice(list(ALPHABETS)), t) for _, t in rows[::9]]
    return G.train([*rows, *wrong])


def test_held_out_accuracy(model):
    rng = random.Random(2)
    scorer = G.Scorer(model)
    right = 0
    for _ in range(10):
        for code in ALPHABETS:
            ((_, _, k, sure, words, _, whole),) = scorer.text(paragraph(code, rng))
            right += G.CODES[k] == code
            assert 0 <= sure <= 1 and words == 24 and whole
    assert right >= 68


def test_held_out_accuracy_on_the_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "language", "text")
    rows = G.labelled_sample(docs)
    cut = len(rows) * 2 // 3
    m = G.train(rows[:cut])
    x = G.features([t for _, t in rows[cut:]])
    names, _ = G.decide(x @ m.weights.T + m.bias, m.slope)
    # about one label in eight is wrong by design
    assert np.mean([G.CODES[k] == c for k, (c, _) in zip(names, rows[cut:])]) > 0.7


def test_word_scores_add_up_to_paragraph_margins(model):
    rng = random.Random(3)
    t = paragraph("tr", rng)
    direct = G.features([t]) @ model.weights.T + model.bias
    scorer = G.Scorer(model)
    rows = np.array([scorer.table[scorer.row(w)] for w in t.split()])
    assert np.allclose(direct[0], rows[:, : G.MACHINES].sum(0) / len(rows) + model.bias, atol=1e-4)


def test_paragraphs_cover_the_text():
    t = "bir\niki\n\n  üç\n\f\ndört\n   beş\n"
    assert [t[a:b].strip() for a, b in G.paragraphs(t)] == ["bir\niki", "üç", "dört", "beş"]
    assert G.paragraphs("") == []


def test_paragraphs_break_where_the_definition_says():
    definition = re.compile(r"\n[^\S\n]*\n\s*|\s*\f\s*|\n(?=[^\S\n]{2,}\S)")
    rng = random.Random(7)
    for _ in range(20_000):
        t = "".join(rng.choice("ab \n\n\f \t\x0b\xa0\x1c") for _ in range(rng.randint(0, 14)))
        cuts = [0, *(x for m in definition.finditer(t) for x in m.span()), len(t)]
        assert G.paragraphs(t) == [(a, b) for a, b in zip(cuts[::2], cuts[1::2]) if a < b], t


def test_grams_are_hashed_as_defined():
    words = ["a", "ağaç", "ʿilm", "كتاب", "𝒳y-z", "", "\ud800k", "uzunbirsözcük"]
    codes, starts = G.grams(words)
    for w, got in zip(words, np.split(codes, starts[1:])):
        m = f"^{w}$"
        seen = [m[i : i + n] for i in range(len(m)) for n in (1, 2, 3, 4) if i + n <= len(m)]
        assert got.tolist() == [zlib.crc32(g.encode("utf-8", "surrogatepass")) % G.DIMENSIONS for g in seen if g not in "^$"]
    assert [len(x) for x in G.grams([])] == [0, 0]


def test_a_word_is_scored_once_and_texts_are_decided_together(model, monkeypatch):
    rng = random.Random(8)
    texts = ["\n\n".join(paragraph(c, rng) for c in ("tr", "ar", "de")) + tail for tail in ("", "\n\n1234 5678", " Kitap, kitap; (KİTAP) kitap")] + ["", "\f"]
    alone = [G.Scorer(model).text(t) for t in texts]
    apart = G.features(texts)
    scored, decided = [], []
    grams, decide = G.grams, G.decide
    monkeypatch.setattr(G, "grams", lambda words: (scored.extend(words), grams(words))[1])
    monkeypatch.setattr(G, "decide", lambda *a: (decided.append(1), decide(*a))[1])
    scorer = G.Scorer(model)
    owner, place, *columns = scorer.columns(texts)
    rows = list(zip(*columns))
    for n, want in enumerate(alone):
        got = [r for o, r in zip(owner, rows) if o == n]
        assert [(*r[:3], *r[4:]) for r in got] == [(*r[:3], *r[4:]) for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-6)
    assert -1 in [r[2] for r in rows]
    assert len(scored) == len(set(scored)) and scored.count("kitap") == 1 and len(decided) == 1
    # words are scored in bounded parts whatever their number and length
    monkeypatch.setattr(G, "_TOGETHER", 5)
    assert np.allclose(G.Scorer(model).columns(texts)[5], columns[3], atol=1e-6) and np.array_equal(G.features(texts), apart)
    monkeypatch.undo()
    # what is held is dropped together and scored anew
    monkeypatch.setattr(G, "grams", lambda words: (scored.extend(words), grams(words))[1])
    monkeypatch.setattr(G, "_HELD", 0)
    scored.clear()
    assert [r[2] for r in zip(*scorer.columns(texts)[2:])] == [r[2] for r in rows] and scored.count("kitap") == 1


def test_label_sets(spark):
    labels = ["tr-TR, English", "Osmanlıca (Latin)", "Osmanlıca", "OTA", "bilinmiyor", "", None, "?", "français; ger", "Türkçe,TUR", "en_GB", "ota-Latn"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").orderBy("i").select(language_set(F.col("x"))).collect()]
    assert got == [["en", "tr"], ["ota-latn"], ["ota"], ["ota"], [], [], [], [], ["de", "fr"], ["tr"], ["en"], ["ota-latn"]]


def test_found(spark, tables):
    rng = random.Random(5)
    rows = []

    def add(label, *codes, tail=""):
        text = "\n\n".join(paragraph(c, rng) for c in codes) + tail
        rows.append((len(rows), label, text, len(text), "s", "f.pdf", "t", None, None, "x", 1))
        return len(rows) - 1

    for c in ALPHABETS:
        for _ in range(12):
            add(c, c, c, c)
    right = add("tr", "tr", "tr", "tr")
    wrong = add("English", "de", "de", "de")
    missing = add(None, "fr", "fr", "fr")
    mixed = add("tr", "tr", "ar", "tr", "ar")
    named = add("Arapça, tur", "tr", "ar", "tr", "ar")
    inside = add("tr", "tr", "tr", "tr", tail=" The harbour with these letters. " + paragraph("tr", rng))
    rows.append((900, None, None, None, None, None, None, None, None, None, None))
    rows.append((901, "en", "", 0, None, None, None, None, None, None, None))
    rows.append((902, None, "Not found (404)", 300, "s", "f.pdf", "t", None, None, "x", 1))
    long = "\n\n".join(paragraph("en", rng) for _ in range(800))
    rows.append((903, "de", long, len(long), "s", "f.pdf", "t", None, None, "x", 1))
    d = tables(documents=spark.createDataFrame(rows + rows[-4:], FIELDS))
    got = sorted((r.doc_id, r.language) for r in G.p4_found(spark, d).collect() if r.doc_id >= right)
    assert got == [(wrong, "de"), (missing, "fr"), (mixed, "ar"), (mixed, "tr"), (903, "en")]
    assert named and inside
    one = {r.doc_id: r for r in G.p4_documents(spark, d).collect()}
    assert one[mixed].languages == "ar,tr" and one[903].language == "en" and one[900].language is None and one[901].confidence == 0 and len(one) == len(rows)
    assert {r.language for r in G.p4_segments(spark, d).filter(f"doc_id = {mixed}").collect()} <= {"ar", "tr"}


def test_responses_of_short_documents_count(spark, tables):
    rng = random.Random(6)
    rows = []
    for c in ALPHABETS:
        for _ in range(12):
            text = "\n\n".join(paragraph(c, rng) for _ in range(3))
            rows.append((len(rows), c, text, len(text), "s", "f.pdf", "t", None, None, "x", 1))
    line = "This page of the harbour ledger rests behind the window glass {}"
    short = [(900 + i, "de", line.format(i), 70, "st"[i % 2], f"k{i}.pdf", f"Kitap {i}", None, None, "x", 1) for i in range(6)]
    text = "\n".join(line.format(i) for i in range(6))
    long = (990, "de", text, len(text), "s", "uzun.pdf", "Uzun", None, None, "x", 1)
    got = {r.doc_id for r in G.p4_found(spark, tables(documents=spark.createDataFrame([*rows, long], FIELDS))).collect()}
    assert 990 in got
    got = {r.doc_id for r in G.p4_found(spark, tables(documents=spark.createDataFrame([*rows, long, *short], FIELDS))).collect()}
    assert 990 not in got


def test_empty(spark, tables):
    d = tables(documents=spark.createDataFrame([], FIELDS))
    assert G.p4_found(spark, d).count() == 0 and G.p4_documents(spark, d).count() == 0
