"""Names, links, components, split shares, leaks."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pagewright.llm import splits as S

DOCS = "doc_id long, document_id string, author string, work string, split string, node string"
PAGES = "document_id string, split string, author string"


def names(spark, f, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_authors_meet_whatever_their_spelling(spark):
    key = lambda c: S.author_key(S.author_name(c))
    got = names(spark, key, "Zühre Rodeçoba", "rodecoba, zuhre", "Z. Rodeçoba", "Rodeçoba, Z.", "ZÜHRE RODEÇOBA", "Dr. Zühre Rodeçoba", "Zühre Rodeçoba (1842-1900)", "Zühre\xa0Rodeçoba ", "Rodeçoba, Zühre")
    assert set(got) == {"rodecoba z"}
    assert names(spark, S.author_name, None, "", " ", "?", "-", "n/a", "[s.n.]", "y.y.", "Anonim", "Bilinmiyor", "Yazarı belirsiz", "Unknown") == [None] * 12


def test_works_meet_whatever_their_volume(spark):
    got = names(spark, S.work_key, "Çıdebaba Defteri", "«Çıdebaba Defteri»", " Cidebaba  Defteri", "ÇIDEBABA DEFTERİ", "Çıdebaba Defteri, Vol. 2", "Çıdebaba Defteri (3. cilt)", "Çıdebaba Defteri, c. II")
    assert set(got) == {"cidebaba defteri"}
    assert names(spark, S.work_key, "Untitled", "Muhtelif", "-", "Başlıksız", None) == [None] * 5
    assert len(set(names(spark, S.work_key, "Tārīḫ-i Zote", "Unutulan Zote", "Zote Tarihi"))) == 3


ROWS = [
    (1, "Leman Kule", "Bir Kitap", "train"), (2, "L. Kule", None, "test"), (3, "Louis Kule", None, "test"), (4, None, "Bir Kitap, Vol. 2", "train"), (5, "Anonim", "Untitled", "test"), (6, "Anonim", "Untitled", "train"),
    (7, "Kule, Leman", "Başka", "validation"), (8, "Orhan Taş", "Başka", "train"), (9, "Orhan Taş", None, "train"),
]


@pytest.fixture
def folder(spark, tables):
    docs = [(i, f"x{i}", a, w, "clash", "clash") for i, a, w, _ in ROWS] + [(None, None, "Leman Kule", None, "c", "c")]
    pages = [(f"x{i}", s, "clash") for i, _, _, s in ROWS for _ in range(3)] + [("x1", None, "c"), (None, "test", "c")]
    return tables(documents=spark.createDataFrame(docs + docs[:2], DOCS), pages=spark.createDataFrame(pages, PAGES))


def test_found(spark, folder):
    got = {(r.doc_id_a, r.doc_id_b) for r in S.p2_found(spark, folder).collect()}
    # Leman and Louis are two people, L. may be either; nameless entries connect nothing
    assert got == {(1, 2), (1, 7), (2, 7), (7, 8)}


def test_related_documents_share_their_split(spark, folder):
    rows = {r.doc_id: r for r in S.p2_splits(spark, folder).collect()}
    assert set(rows) == set(range(1, 10))
    assert len({rows[i].component for i in (1, 2, 3, 4, 7, 8, 9)}) == 1 and rows[5].component != rows[6].component
    for a, b in combinations(rows.values(), 2):
        assert a.component != b.component or a.split == b.split


def test_shares_follow_the_proportions(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("author"), F.lit("?").alias("work"))
    n = {r.split: r["count"] for r in S.assign_splits(docs).groupBy("split").count().collect()}
    assert abs(n["train"] / 20_000 - 0.9) < 0.01 and abs(n["test"] / 20_000 - 0.05) < 0.01


def test_a_component_keeps_its_split_as_the_table_grows(spark):
    rows = [(i, "Ali Veli" if i < 40 else None, None) for i in range(400)]
    few, all_ = (S.assign_splits(spark.createDataFrame(rows[:n], "doc_id long, author string, work string")).collect() for n in (45, 400))
    assert {r.doc_id: r.split for r in few}.items() <= {r.doc_id: r.split for r in all_}.items()


def test_an_initial_ties_what_it_may_stand_for(spark):
    fields = "doc_id long, author string, work string"
    got = {r.doc_id: r.component for r in S.assign_splits(spark.createDataFrame([(1, "Ali Veli", None), (2, "Ahmet Veli", None), (3, "Veli, Ali", None)], fields)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    got = {r.doc_id: r.component for r in S.assign_splits(spark.createDataFrame([(1, "Ali Veli", None), (2, "Ahmet Veli", None), (3, "A. Veli", None)], fields)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_empty(spark, tables):
    d = tables(documents=spark.createDataFrame([], DOCS), pages=spark.createDataFrame([], PAGES))
    assert S.p2_found(spark, d).count() == 0 and S.p2_splits(spark, d).count() == 0
