"""Catalog, roll-ups, pages, exports and events on small tables."""

import json
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagewright.operators import catalog as K
from pagewright.operators import pages as P
from pagewright.operators import rollup as R
from pagewright.operators.edges import recognize_pages, render_pages
from pagewright.plans import exports as X
from pagewright.sources import files
from pagewright.functions.quality import with_quality
from pagewright.operators.ranks import ordered_rank
from pagewright.sources.tables import commit, table
from pagewright.streaming import events as E

T0 = datetime(2024, 1, 1)


def test_pages_pad_cut_and_join(spark):
    df = spark.createDataFrame([(1, "a\n\f\nb", 3, "x"), (2, "a\n\f\nb\n\f\nc", 2, "x"), (3, None, 1, "x"), (4, "q", -1, "x"), (5, "q", None, "x")], "d int, t string, n int, page_num string")
    rows = {(r.d, r.page_num): r.page_text for r in P.explode_pages(df, "t", "n").collect()}
    assert rows == {(1, 1): "a", (1, 2): "b", (1, 3): "", (2, 1): "a", (2, 2): "b", (3, 1): ""}
    back = P.join_pages(spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, None)], "d int, page_num int, t string"), ["d"], "t")
    assert back.first().text == "a\n\f\nb\n\f\n"


def test_round_trip_of_pages(spark, small):
    docs = table(spark, small, "documents", "document_id", "text")
    again = P.join_pages(P.explode_pages(docs, "text"), ["document_id"], "page_text", out="again")
    assert docs.join(again, "document_id").filter("text <> again").count() == 0


def test_retry_keeps_first_good_else_last(spark):
    df = spark.createDataFrame([("a", 1, "fail"), ("a", 2, "warn"), ("a", 3, "pass"), ("b", 1, "fail"), ("b", 2, "empty")], "p string, n int, s string")
    assert {(r.p, r.n) for r in P.pick_attempt(df, ["p"], "n", "s").collect()} == {("a", 2), ("b", 2)}


def test_profile(spark):
    rows = spark.createDataFrame([(10, 1, 3, 1), (60, 1, 3, 1), (60, 0, 21, 1), (60, 0, 1, 6), (60, 0, 1, 1)], "t int, i int, b int, m int")
    p = [r.p for r in rows.select(P.page_profile(F.col("t"), F.col("i"), F.col("b"), F.col("m"), F.lit(2.0), F.lit(1.0)).alias("p")).collect()]
    assert [x.estimated_complexity for x in p] == ["moderate", "moderate", "complex", "complex", "simple"]
    assert [x.recommended_dpi for x in p] == [300, 200, 200, 200, 200] and p[0].is_image_only and p[0].is_landscape


def test_dominant_breaks_ties_by_first_page(spark):
    df = spark.createDataFrame([("d", 1, "b"), ("d", 2, "a"), ("d", 3, "a"), ("d", 4, "b"), ("e", 1, None)], "d string, n int, v string")
    got = {r.d: r.o for r in R.dominant(df, ["d"], "v", "n", "o", "unknown").collect()}
    assert got == {"d": "b", "e": "unknown"}


def catalog(spark):
    fields = "document_id string, filename string, source_path string, file_size_bytes long, total_pages int, pdf_title string, pdf_author string, pdf_creation_date string, pdf_producer string, display_title string, group_path string, author string, work string, book string, document_date_label string, document_date_precision string, language string, script string, license string, source_citation string, notes string, tags_json string, file_sha256 string, first_seen_at timestamp, last_seen_at timestamp, catalog_updated_at timestamp"
    none = [None] * 3
    rows = [
        ("d1", "bir.pdf", "s/bir", 10, 2, "PDF bir", None, None, None, "", "Tarih", "A", "W", None, "1900", "year", "tr", "Latn", "cc", None, None, None, "h1", T0, T0, None),
        ("d2", "iki.pdf", "", 20, None, None, *none, None, " Tarih ", *none, *none, *none, None, "[]", "h2", T0, T0, None),
    ]
    return spark.createDataFrame(rows, fields)


def test_upsert_keeps_curated_fields(spark):
    docs = catalog(spark)
    new = spark.createDataFrame([("d1", "yeni.pdf", "s/yeni", 11, None, None, "P", None, None, datetime(2025, 1, 1)), ("d3", "üç.pdf", "s/üç", 5, 1, None, None, None, None, datetime(2025, 1, 1))], "document_id string, filename string, source_path string, file_size_bytes long, total_pages int, pdf_title string, pdf_author string, pdf_creation_date string, pdf_producer string, last_seen_at timestamp")
    got = {r.document_id: r for r in K.upsert_documents(docs, new).collect()}
    assert set(got) == {"d1", "d2", "d3"}
    assert (got["d1"].filename, got["d1"].total_pages, got["d1"].pdf_title, got["d1"].pdf_author, got["d1"].author, got["d1"].first_seen_at) == ("yeni.pdf", 2, "PDF bir", "P", "A", T0)
    assert got["d3"].first_seen_at == datetime(2025, 1, 1) and got["d2"].filename == "iki.pdf"


def test_patch_is_all_or_nothing(spark):
    docs = catalog(spark)
    with pytest.raises(KeyError, match="d0"):
        K.patch_documents(docs, ["d1", "d0", "d9"], {"license": "x"}, F.current_timestamp())
    got = {r.document_id: r for r in K.patch_documents(docs, ["d2"], {"license": "x", "filename": "no"}, F.lit(T0)).collect()}
    assert got["d2"].license == "x" and got["d2"].filename == "iki.pdf" and got["d2"].catalog_updated_at == T0 and got["d1"].catalog_updated_at is None
    assert K.patch_documents(docs, ["d2"], {"filename": "no"}, F.lit(T0)).exceptAll(docs).count() == 0


def test_titles_completeness_and_groups(spark):
    rows = catalog(spark).select("document_id", K.display_title().alias("t"), K.metadata_complete().alias("c"), K.group_name().alias("g")).orderBy("document_id").collect()
    assert [(r.t, r.c, r.g) for r in rows] == [("PDF bir", 1, "Tarih"), ("iki.pdf", 0, "Tarih")]
    assert [r.document_id for r in K.search(catalog(spark), " BIR ", "Tarih").collect()] == ["d1"]


def runs_and_links(spark):
    runs = spark.createDataFrame([("r1", "failed", "ocr", None, T0, None), ("r2", "processing", "ocr", None, datetime(2024, 2, 1), None), ("r3", "completed", "done", None, datetime(2024, 3, 1), T0)], "id string, status string, stage string, error string, created_at timestamp, completed_at timestamp")
    links = spark.createDataFrame([("r1", "d1", "pending", None, None), ("r1", "d2", "completed", T0, T0), ("r2", "d1", "processing", T0, None), ("r3", "d1", "completed", T0, T0)], "run_id string, document_id string, status string, started_at timestamp, completed_at timestamp")
    return runs, links


def test_sweeps_retries_and_latest(spark):
    runs, links = runs_and_links(spark)
    swept, swept_links = K.sweep_orphans(runs, links, F.lit(T0))
    assert {r.id: r.status for r in swept.collect()} == {"r1": "failed", "r2": "failed", "r3": "completed"}
    assert {(r.run_id, r.document_id): r.status for r in swept_links.collect()} == {("r1", "d1"): "pending", ("r1", "d2"): "completed", ("r2", "d1"): "failed", ("r3", "d1"): "completed"}
    assert {(r.run_id, r.document_id): r.status for r in K.sweep_failed_runs(runs, links, F.lit(T0)).collect()}[("r1", "d1")] == "failed"
    assert [(r.run_id, r.document_id) for r in K.retryable(runs, links, catalog(spark)).collect()] == [("r1", "d1")]
    latest = {r.document_id: (r.latest_run_id, r.latest_run_status) for r in K.latest_runs(links, runs).collect()}
    assert latest == {"d1": ("r3", "completed"), "d2": ("r1", "failed")}
    assert {r.run_id: r.document_id for r in K.current_document(links).collect()} == {"r1": "d1", "r2": "d1", "r3": "d1"}


def test_delete_run_cascades(spark):
    runs, links = runs_and_links(spark)
    left = K.delete_run("r1", runs, links, links, links)
    assert [t.count() for t in left] == [2, 2, 2, 2]
    with pytest.raises(ValueError):
        K.delete_run("r2", runs, links, links, links)


def test_page_upsert_resets_unset_fields(spark):
    pages = spark.createDataFrame([("r", "d", 1, "pass", 200), ("r", "d", 2, "fail", 200)], "run_id string, document_id string, page_num int, status string, dpi_used int")
    new = spark.createDataFrame([("r", "d", 2), ("r", "d", 3)], "run_id string, document_id string, page_num int")
    assert sorted((r.page_num, r.status, r.dpi_used) for r in K.upsert_pages(pages, new).collect()) == [(1, "pass", 200), (2, "pending", None), (3, "pending", None)]


def test_dataset_export(spark, small, tmp_path):
    pages, docs = table(spark, small, "pages"), table(spark, small, "documents")
    run = pages.agg(F.min("run_id")).first()[0]
    bundle = X.write_dataset(pages, docs, run, str(tmp_path / "dataset"))
    manifest = json.loads((tmp_path / "dataset/manifest.json").read_text())
    rows = spark.read.parquet(str(tmp_path / "dataset/pages.parquet"))
    assert manifest["pages_count"] == rows.count() == pages.filter(F.col("run_id") == run).select(*X.PAGE_KEYS).distinct().count()
    assert len(manifest["columns"]["pages"]) == 36 and len(manifest["columns"]["documents"]) == 34
    assert rows.groupBy("document_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    assert zipfile.ZipFile(bundle).namelist() and not Path(str(tmp_path / "dataset") + ".tmp").exists()
    X.write_dataset(pages, docs, run, str(tmp_path / "dataset"))  # a second export replaces the first


def test_text_bundle_selects_and_names(spark, small, tmp_path):
    pages, docs, links = table(spark, small, "pages"), table(spark, small, "documents"), table(spark, small, "run_documents")
    run, doc = links.filter("status = 'completed'").join(pages.filter("length(clean_text) > 0"), ["run_id", "document_id"]).select("run_id", "document_id").orderBy("run_id", "document_id").first()
    chosen = spark.createDataFrame([(doc,)], "document_id string")
    X.write_bundle(pages, links, docs, run, str(tmp_path / "bundle"), chosen)
    files_ = sorted(p.relative_to(tmp_path / "bundle").as_posix() for p in (tmp_path / "bundle").rglob("*.txt"))
    assert len(files_) == 3 and all(f.endswith(f"__{doc[:8]}.txt") for f in files_)
    assert spark.read.json(str(tmp_path / "bundle/documents.jsonl")).count() == 1
    with pytest.raises(KeyError, match="nowhere"):
        X.write_bundle(pages, links, docs, run, str(tmp_path / "other"), spark.createDataFrame([("nowhere",)], "document_id string"))


def test_pairs(spark, small, tmp_path):
    pages, docs, links = table(spark, small, "pages"), table(spark, small, "documents"), table(spark, small, "run_documents")
    with pytest.raises(ValueError):
        X.pair_rows(pages, links, docs, "other")
    rows = X.pair_rows(pages, links, docs, "raw").withColumn("image_bytes", F.encode("id", "UTF-8"))
    run = rows.agg(F.min("run_id")).first()[0]
    X.write_pairs(rows, run, str(tmp_path / "pairs"), "raw")
    back = spark.read.json(str(tmp_path / "pairs/rows"))
    assert back.count() == rows.filter(F.col("run_id") == run).count() and set(back.columns) >= {"split", "image_sha256", "label_source"}
    assert len(list((tmp_path / "pairs/images").iterdir())) == back.count()


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"y")
    (tmp_path / "c.txt").write_text("metin\n\f\nson", encoding="utf-8")
    assert [r.name for r in files.list_pdfs(spark, str(tmp_path)).collect()] == ["a.PDF", "b.pdf"]
    hashed = {r.path.rsplit("/", 1)[1]: r for r in files.hash_files(spark, str(tmp_path), "*.pdf").collect()}
    assert hashed["b.pdf"].document_id == hashed["b.pdf"].sha256[:16]
    paths = spark.createDataFrame([(str(tmp_path / "c.txt"),), (str(tmp_path / "none.txt"),)], "p string")
    assert {r.p.rsplit("/", 1)[1]: r.text for r in files.read_texts(spark, paths, "p", str(tmp_path)).collect()} == {"c.txt": "metin\n\f\nson", "none.txt": ""}


def test_recognition_retries(spark):
    from pagewright.functions.clean import clean

    pages = spark.createDataFrame([("a.pdf", 1, 200), ("b.pdf", 1, 300)], "path string, page_num int, dpi int")
    drawn = render_pages(pages, lambda p, n, d: f"{p}/{n}/{d}".encode())

    def read(image, mode):
        return "Bir satır.\nBaşka bir satır daha." if image.startswith(b"a") or mode == "free_ocr" else ""

    got = {r.path: (r.attempt, r.mode, r.quality.status) for r in recognize_pages(drawn, read, clean, ["path", "page_num"]).collect()}
    assert got == {"a.pdf": (1, "markdown", "pass"), "b.pdf": (2, "free_ocr", "pass")}


LOG = [
    (1, "r", "run_started", "{}", T0), (2, "r", "page_complete", '{"processing_time_ms": 500, "token_count": 250, "validation_status": "pass"}', T0), (3, "r", "page_complete", '{"processing_time_ms": 250, "token_count": 150, "validation_status": "warn"}', T0),
    (4, "r", "page_retry", "{}", T0), (5, "s", "run_started", "{}", T0), (6, "s", "run_failed", "not json", T0), (2, "r", "page_complete", '{"processing_time_ms": 500, "token_count": 250, "validation_status": "pass"}', T0),
]


def log(spark):
    return spark.createDataFrame(LOG, E.SCHEMA)


def test_counters_and_rates(spark):
    r = E.rates(E.counters(E.once(log(spark)))).first()
    assert (r.jobs_created, r.jobs_failed, r.active_jobs, r.pages_processed, r.pages_warn, r.tokens, r.time_tenths) == (2, 1, 1, 2, 1, 400, 7500)
    assert abs(r.tokens_per_second - 400 / 0.75) < 1e-9 and r.page_latency_ms == 375.0
    empty = E.rates(E.counters(log(spark).limit(0))).first()
    assert empty.tokens_per_second == 0.0 and empty.page_latency_ms == 0.0
    assert any(x.line == "pages_tokens 400" for x in E.prometheus(E.rates(E.counters(E.once(log(spark))))).collect())


def test_progress(spark):
    runs = spark.createDataFrame([("r", 2), ("s", 0)], "id string, pages_total int")
    got = {r.run_id: r.progress for r in E.with_progress(E.run_state(E.once(log(spark))), runs).collect()}
    assert got == {"r": 0.99, "s": 0.0}
    assert [r.id for r in E.replay(log(spark), "r", after=1).collect()] == [2, 3, 4]


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    path = str(tmp_path / "states")
    for part in (LOG[:3], LOG[3:]):
        E.append(spark.createDataFrame(part, E.SCHEMA), str(tmp_path / "log"))
        E.progress_stream(spark, str(tmp_path / "log"), str(tmp_path / "checkpoint"), path).awaitTermination()
    batch = E.run_state(E.once(log(spark))).collect()
    assert sorted(spark.read.parquet(path).collect()) == sorted(batch) and len(batch) == 2


def test_lifecycle(spark):
    rows = [(1, "a", "run_started"), (2, "b", "run_started"), (3, "b", "dataset_export_started"), (4, "c", "run_complete"), (2, "c", "run_started"), (5, "d", "run_failed"), (6, "e", "page_start")]
    got = {r.run_id: (r.status, r.stage, r.last_event) for r in E.lifecycle(spark.createDataFrame(rows, "id long, run_id string, event_type string")).collect()}
    assert got == {"a": ("processing", "ocr", "run_started"), "b": ("processing", "exporting", "dataset_export_started"), "c": ("completed", "completed", "run_complete"), "d": ("failed", "failed", "run_failed"), "e": ("queued", "queued", "page_start")}


def test_following_stops_at_the_end(spark, tmp_path):
    folder, seen = str(tmp_path / "log"), []
    take = lambda rows: seen.extend(r.id for r in rows.collect())
    E.append(log(spark), folder)
    assert not E.follow_to_end(spark, folder, "r", str(tmp_path / "c1"), take, timeout=0) and sorted(seen) == [1, 2, 3, 4]
    E.append(spark.createDataFrame([(9, "r", "run_complete", "{}", T0), (3, "r", "page_complete", "{}", T0)], E.SCHEMA), folder)
    seen.clear()
    # goes on where it stopped, and an event that came before does not come again
    assert E.follow_to_end(spark, folder, "r", str(tmp_path / "c1"), take) and seen == [9]
    seen.clear()
    assert E.follow_to_end(spark, folder, "s", str(tmp_path / "c2"), take, after=5) and seen == [6]


def test_commit_replaces_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    commit(spark.range(3), path)
    # the new rows may be made from the old ones
    assert commit(spark.read.parquet(path).selectExpr("id + 10 AS id"), path).count() == 3
    assert {r.id for r in spark.read.parquet(path).collect()} == {10, 11, 12} and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        commit(spark.range(1).selectExpr("assert_true(id > 5) AS x"), path)
    assert spark.read.parquet(path).count() == 3


def test_update_and_scope(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert {tuple(r) for r in K.update_rows(df, F.col("s") == "a", i=7).collect()} == {(7, "a"), (2, None)}
    with pytest.raises(KeyError):
        K.update_rows(df, F.lit(True), other=1)
    assert X.export_scope(None) == "all" and X.export_scope(["b", "a"]) == X.export_scope(["a", "b"]) and len(X.export_scope(["a"])) == 12
    assert X.export_name("text_bundle") == "text_bundle_all" and X.export_name("ocr_pairs", ["x"], "raw", 200).startswith("ocr_pairs_raw_200_")


def test_uploads_are_written(spark, tmp_path):
    rows = [("a/b.pdf", b"1"), ("a/b.pdf", b"1"), ("c.PDF", b""), ("..pdf", b"2"), (None, b"3"), ("d.pdf", None), ("e.txt", b"4")]
    got = files.store_uploads(spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "filename string, content binary"), str(tmp_path / "in")).collect()
    assert sorted(p.name for p in (tmp_path / "in").iterdir()) == sorted({r.stored for r in got if not r.refused}) and sum(r.refused for r in got) == 4
    assert all(Path(r.path).read_bytes() in (b"1", b"") for r in got if not r.refused)


def test_ordered_rank_of_a_hot_group(spark):
    rows = [("hot", i * 7 % 500, i) for i in range(500)] + [("cold", None, i) for i in range(5)] + [("cold", 3, 9)]
    df = spark.createDataFrame(rows, "g string, t int, i int")
    got = ordered_rank(df, ["g"], [F.col("t").asc_nulls_last(), F.col("i").asc()], "r").collect()
    for g in ("hot", "cold"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [r.r for r in own] == list(range(1, len(own) + 1))
        assert [(r.t is None, r.t, r.i) for r in own] == sorted(((r.t is None, r.t, r.i) for r in own), key=lambda k: (k[0], k[1] or 0, k[2]))


def test_a_filter_on_quality_evaluates_no_rule_twice(spark):
    df = with_quality(spark.createDataFrame([(1, "metin")], "n int, t string"), "t", "n").filter("quality.status = 'fail'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 4 and plan.count("_top_character(") == 1


def test_follow_one_run(spark, tmp_path):
    E.append(log(spark), str(tmp_path / "log"))
    q = E.follow(spark, str(tmp_path / "log"), "r", 1).writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.table("followed").collect()) == [2, 3, 4]
