"""Lines of templates, filler, failures and demands; documents made of them."""

import unicodedata

import pytest

from pagewright.functions.fold import fold_text, py_fold
from pagewright.llm import residue as X

FIELDS = "doc_id long, source string, filename string, display_title string, pdf_title string, work string, text string, n long, kind string"


@pytest.mark.parametrize(
    "line,kind",
    [
        ("Sayın {{ad}}, {{ tarih }} tarihli başvurunuz", "field"), ("Dear ${author}", "field"), ("Cilt: [[cilt]]", "field"), ("#{konu}", "field"), ("<%= body %>", "field"), ("%title% / %body%", "field"), ("@@eser@@", "field"),
        ("__recipient__", "field"), ("<insert konu here>", "field"), ("[yazar giriniz]", "field"), ("Title: <date>, edited by <date>", "field"), ("Eser: [kurum]  Yazar: [baslik]", "field"), ("{% tarih %}", "field"),
        ("mektup [tarih] hanesi sonradan el ile doldurulmuş", None), ("gösterilir ve <n> işareti eksik yaprağı bildirir.", None), ("Küme {a, b, c} biçiminde", None), ("[okunamadı] ve [...] işaretleri", None), ("[12]", None),
        ("Lorem ipsum dolor sit amet", "filler"), ("metin metin metin metin metin", "filler"), ("your text here your text here", "filler"), ("Blindtext", "filler"), ("texte à venir", "filler"), ("xxx xxx xxxx xxx xxx xxxx", "filler"), ("deneme 123 deneme", "filler"),
        ("denemesinde lorem ipsum diye başlayan satırlar kullanıldığı", None), ("Yağmur yağdı ve sokaklar ıslandı.", None), ("", None), ("quis", None),
        ("504 Sayfa bulunamadı", "failure"), ("GÖRÜNTÜ BULUNAMADI VEYA TAŞINDI", "failure"), ("Erreur 404 : page introuvable", "failure"), ("Diese Seite wurde nicht gefunden", "failure"), ("The scan has moved or been removed.", "failure"), ("THIS RECORD REQUIRES YOU TO SIGN IN", "failure"),
        ("Bu sayfa görüntülenemiyor", "failure"), ("404 – Seite existiert nicht", "failure"), ("Service is down for maintenance", "failure"), ("HTTP 503", "failure"), ("403 Forbidden", "failure"), ("He was forbidden to enter.", None),
        ("Gateway did not answer in time, code 502", "failure"), ("Cette image n'est pas disponible", "failure"), ("Bu görüntüye erişim izniniz yok.", "failure"), ("numaralı defterin bulunamadığı iki kez", None), ("Hata 404 lira olarak deftere geçmiş", None),
        ("Please turn on JavaScript to read this page.", "demand"), ("Checking your browser before opening the archive…", "demand"), ("Tarayıcınız desteklenmiyor, lütfen güncelleyin.", "demand"), ("İnsan olduğunuzu doğrulayın, ardından sayfa yüklenecek.", "demand"),
        ("You need cookies and scripts enabled to open the reader.", "demand"), ("Bitte aktivieren Sie JavaScript, um den Band anzuzeigen.", "demand"),
    ],
)
def test_lines(line, kind):
    assert X.kind_of(line, py_fold(line)) == kind
    if kind in ("field", "failure", "demand"):
        # whatever the patterns mark, the screen lets through
        assert line in X.screened_lines("Düz bir satır.\n" + line + "\nDüz bir satır daha.")


LONG = [
    "metin metin metin metin metin metin", "alt üst alt üst alt üst", "Duis aute irure dolor in reprehenderit in voluptate velit esse", "Excepteur sint occaecat cupidatat non proident",
    unicodedata.normalize("NFD", "Görüntü yüklenemedi"), "ÖRNEK METİN", "Sayfa\u00ad bulu\u00adnamadı", "bla  bla", "texte d’exemple",
]


@pytest.mark.parametrize("line", LONG)
def test_length_of_a_text_hides_no_line(line):
    kind = X.kind_of(line, py_fold(line))
    many = "\n".join([line] * (3000 // len(line)))
    assert {k for _, _, k in X.kinds_of(many)} == {kind}
    prose = "\n".join(f"Satır {i}: " + " ".join(f"söz{chr(97 + i % 26)}{chr(97 + j)}" for j in range(9)) for i in range(60))
    assert [x for x, _, k in X.kinds_of(prose + "\n" + line + "\n\f\n" + prose) if k] == ([line] if kind else [])


def test_whole_texts_are_folded_as_words_are():
    text = "".join(map(chr, range(0x110000)))
    for part in (text, text.replace("Σ", ""), "", "ΟΔΟΣ Σ’\nİstanbul’da 12_a²", "Gökçe’nin\nİ́ 3. kitabı\n"):
        folded, letters = fold_text(part)
        assert folded == py_fold(part)
        assert [x.split() for x in letters.split("\n")] == [X.WORDS.findall(x) for x in folded.split("\n")]


def test_no_line_is_folded_or_matched_for_its_letters_alone(monkeypatch):
    seen = []
    is_filler = X.is_filler
    monkeypatch.setattr(X, "is_filler", lambda folded: (seen.append(folded), is_filler(folded))[1])
    lines = ["Kapı", "deniz ve gemi", "lorem", "sed non qui", "dolor", "sed kapı non deniz", "alt üst alt üst", "a b c d e a b c d e", "ve ve ve ve", "est et", "metin gelecek", "Sayfa bulunamadı", "1234", " ", "bir iki üç dört beş altı"]
    assert [(x, k) for x, _, _, k in X.judged_lines("\n".join(lines))] == [(x, X.kind_of(x, py_fold(x))) for x in lines if x.strip()]
    # the lines without a literal are judged by the words at hand, the others once here and once by the line above
    assert seen.count("deniz ve gemi") == 1 and seen.count(py_fold("Sayfa bulunamadı")) == 2


def test_literals_cover_every_alternative():
    assert X.needed("(ab|cde)f?|g+hi") == {"ab", "cde", "hi"} and X.needed(r"\bx+ (no|yes)\w*") == {"no", "yes"}
    with pytest.raises(ValueError):
        X.needed(r"abc|\d+")
    for pattern in (X.MARKS, X.FILLER_PHRASES, X.FAILURE, X.DEMAND):
        assert X.needed(pattern.pattern)


def test_long_filler_is_found(spark, tables):
    rows = [(i, "S", f"kitap_{i}.pdf", f"Başlık {i}", None, None, "\n".join([t] * (3000 // len(t))), 1, "x") for i, t in enumerate(LONG[:5])]
    rows += [(9, "S", "k.pdf", "B", None, None, "metin " * 2000, 1, "x")]
    d = tables(documents=spark.createDataFrame(rows, FIELDS))
    assert sorted(r.doc_id for r in X.p9_found(spark, d).collect()) == [0, 1, 2, 3, 4, 9]


def test_found(spark, tables):
    prose = "\n".join(f"Bu {i}. satır gerçek bir kitabın içinden alınmış {w} bir metindir." for i, w in enumerate("uzun kısa eski yeni derin geniş dar ince kalın büyük küçük sessiz".split() * 4))
    rows = [
        (1, prose), (2, "404 Not found\nPlease turn on JavaScript to read this page."), (3, prose + "\nReader was told that JavaScript had to be enabled."), (4, "Viewer\nDear {{name}}, the volume {{title}} is here."), (5, ""), (6, None), (7, "metin metin metin\nmetin metin metin metin"),
        (8, "\n".join(["Lorem ipsum dolor sit amet consectetur."] * 3) + "\nGerçek bir satır burada."), (9, "\n".join(["{{a}}"] * 2) + "\n" + prose), (10, prose * 300), (11, "{{" * 50_000), (12, "Kısa ama gerçek bir not."),
    ]
    rows += [(100 + i, f"The archive page rests behind glass {i}") for i in range(6)]
    full = [(i, "ST"[i % 2], f"kitap_{i}.pdf", f"Başlık {i}" if i != 12 else None, None, None, t, 1, "x") for i, t in rows]
    d = tables(documents=spark.createDataFrame(full + full[:4], FIELDS))
    got = sorted(r.doc_id for r in X.p9_found(spark, d).collect())
    # a line that returns under many titles at two hosts is a response though no pattern knows it
    assert got == [2, 4, 7, 8, *range(100, 106)]
    marked = {r.doc_id: r for r in X.p9_marked(spark, d).collect()}
    assert len(marked) == len(rows) and marked[6].n_chars == 0 and not marked[6].is_residue and marked[100].kind == "repeated"
    assert X.p9_kept(spark, d).count() == len(rows) - len(got)
    assert sum(r.residue for r in X.p9_hosts(spark, d).collect()) == len(got)


def test_responses_of_any_wording_and_length(spark, tables):
    notice = "\n".join(f"Paragraf {w} bu vitrinde şimdilik hiçbir şey sergilenmiyor ve {w} kapalı duruyor" for w in "bir iki üç dört beş altı yedi sekiz dokuz on".split() * 5)
    assert len(notice) > 2400
    rows = [(i, "AB"[i % 2], f"cilt{i}.pdf", f"Başlık Numara{chr(97 + i)}", None, None, notice, 1, "x") for i in range(6)]
    # one host alone needs more titles; a body that names its title is no response; a line in every book is little of each
    rows += [(20 + i, "A", f"cilt{i}.pdf", f"Eser{chr(97 + i)}", None, None, "kapının önünde bekleyen uzun kuyruk", 1, "x") for i in range(6)]
    rows += [(40 + i, "AB"[i % 2], f"cilt{i}.pdf", "Tarihçe", None, None, "tarihçe adlı eserin içindeki ilk satır", 1, "x") for i in range(6)]
    rows += [(60 + i, "AB"[i % 2], f"cilt{i}.pdf", f"Roman{chr(97 + i)}", None, None, "bu kitap ilk kez basıldı\n" + "\n".join(f"söz{chr(97 + i)}{chr(97 + j)} ve başka bir cümle {chr(97 + i)}{chr(97 + j)} daha" for j in range(9)), 1, "x") for i in range(6)]
    rows += [(80 + i, "A", f"cilt{i}.pdf", f"Yazı{chr(97 + i)}", None, None, "raflar düzenlenirken geçici olarak boş", 1, "x") for i in range(15)]
    d = tables(documents=spark.createDataFrame(rows + rows[:3], FIELDS))
    assert sorted(r.doc_id for r in X.p9_found(spark, d).collect()) == [*range(6), *range(80, 95)]


def test_empty(spark, tables):
    d = tables(documents=spark.createDataFrame([], FIELDS))
    assert X.p9_found(spark, d).count() == 0 and X.p9_hosts(spark, d).count() == 0
