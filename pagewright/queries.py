"""Queries over the driver's tables, one or more for each operator, with the SQL that must give the same rows.

``QUERIES[name](spark, folder)`` runs over whole tables. ``ORACLE_SQL[name]`` is for DuckDB; operators that SQL cannot
express there (a back-reference, a full entity table, Unicode character classes) have none and are held against brute force in the tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import clean as C
from pagewright.functions import labels as L
from pagewright.functions import script as S
from pagewright.functions.classes import text_lines
from pagewright.functions.quality import longest_run, marker_artifacts, with_quality
from pagewright.operators import catalog as K
from pagewright.operators import edges as G
from pagewright.operators import pages as P
from pagewright.operators import rollup as R
from pagewright.operators.ranks import ordered_rank
from pagewright.plans import exports as X
from pagewright.sources import files
from pagewright.sources.tables import local_shared_dir, table
from pagewright.streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SPACE_SQL = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BREAK_SQL = "chr(10) || chr(12) || chr(10)"
#: Distinct page rows; repeated rows of the table are equal.
PAGES_SQL = "pages_once AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY run_id, document_id, page_num ORDER BY page_id) = 1)"
RUNDOCS_SQL = "rd AS (SELECT DISTINCT * FROM run_documents)"
HASH_SQL = "(('0x' || substr(sha256({0}), 1, 8))::BIGINT % 100)"
SPLIT_SQL = "CASE WHEN {0} < 90 THEN 'train' WHEN {0} < 95 THEN 'validation' ELSE 'test' END"
LIST_SQL = "list_filter(list_transform(string_split(coalesce({0}, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


def lines_sql(text: str) -> str:
    """The stripped lines of a text that hold anything, as a list."""
    return f"list_filter(list_transform(string_split({text}, chr(10)), lambda x: regexp_replace(x, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')), lambda x: x <> '')"


def query(sql: str | None = None):
    """Register a query under the name of its function, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def micros(c: str):
    return F.unix_micros(c).alias(c)


def pages_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Distinct page rows over the given columns and the key."""
    return X.unique_pages(table(spark, d, "pages", *dict.fromkeys([*X.PAGE_KEYS, *columns])))


def linked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_documents").distinct()


# ---------------------------------------------------------------- sources and pages


def artifacts(spark: SparkSession, d: str, suffix: str) -> str:
    """A folder with the text of every document in a file of its own, named by its id."""
    folder = f"{local_shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents", "document_id", "text").withColumn("path", F.concat("document_id", F.lit(suffix)))
    os.makedirs(folder, exist_ok=True)
    atexit.register(shutil.rmtree, folder, True)
    X.write_texts(docs, folder, "path", "text")
    return folder


@query("SELECT document_id || '.PDF' AS name, strlen(coalesce(text, ''))::BIGINT AS size FROM documents WHERE coalesce(text, '') <> ''")
def src1_list_files(spark, d):
    """The listing of a folder of files, their names and sizes; nothing of them is read."""
    return files.list_pdfs(spark, artifacts(spark, d, ".PDF")).select("name", F.col("size").cast("bigint").alias("size"))


@query("SELECT document_id || '.PDF' AS name FROM documents WHERE coalesce(text, '') <> ''")
def src2_expand_inputs(spark, d):
    """A folder, one of its files again and a path of nothing, expanded to the files there are."""
    folder = artifacts(spark, d, ".PDF")
    first = files.list_pdfs(spark, folder).agg(F.min("path")).first()[0]
    return files.expand_inputs(spark, [folder, folder + "/none.pdf", *([first] if first else [])]).select("name")


@query("""
WITH u AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'dir/' || doc_id || '.txt' WHEN doc_id % 7 = 1 THEN doc_id || '..pdf' ELSE 'C:\\scans\\' || doc_id || '.Pdf' END AS filename, coalesce(text, '') AS text FROM documents)
SELECT regexp_replace(filename, '^.*[/\\\\]', '') AS filename, CASE WHEN doc_id % 7 > 1 THEN substr(sha256(text), 1, 16) || '__' || doc_id || '.Pdf' END AS stored, strlen(text)::BIGINT AS size, sha256(text) AS file_sha256, doc_id % 7 <= 1 AS refused FROM u""")
def src3_store_uploads(spark, d):
    """Uploads under good and bad names, stored by hash and name."""
    docs = table(spark, d, "documents", "doc_id", "text")
    i = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("dir/"), i, F.lit(".txt"))).when(F.col("doc_id") % 7 == 1, F.concat(i, F.lit("..pdf"))).otherwise(F.concat(F.lit("C:\\scans\\"), i, F.lit(".Pdf")))
    folder = f"{local_shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)
    return files.store_uploads(docs.select(name.alias("filename"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), folder).select("filename", "stored", "size", "file_sha256", "refused")


def _text_facts(content: bytes) -> dict:
    """Stands for a PDF reader: the pages and the first line of a text file; files of odd size cannot be read."""
    if len(content) % 2:
        raise ValueError("odd")
    text = content.decode("utf-8")
    return {"total_pages": len(text.split(P.PAGE_BREAK)), "title": text.split("\n")[0]}


@query(f"""
SELECT document_id, CASE WHEN strlen(text) % 2 = 0 THEN len(string_split(text, {BREAK_SQL})) END::BIGINT AS total_pages, CASE WHEN strlen(text) % 2 = 0 THEN string_split(text, chr(10))[1] END AS pdf_title, CASE WHEN strlen(text) % 2 = 1 THEN 'odd' END AS pdf_error FROM documents WHERE text IS NOT NULL""")
def src5_file_facts(spark, d):
    """Facts an injected reader tells of every file."""
    docs = table(spark, d, "documents", "document_id", "text").filter("text is not null").select("document_id", F.encode("text", "UTF-8").alias("content"))
    return G.pdf_facts(docs, _text_facts).select("document_id", F.col("total_pages").cast("bigint").alias("total_pages"), "pdf_title", "pdf_error")


@query("SELECT doc_id, sha256(to_base64(encode(coalesce(text, '')))) AS hash FROM documents")
def edge7_base64(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.sha2(G.image_text(F.encode(F.coalesce("text", F.lit("")), "UTF-8")), 256).alias("hash"))


@query("SELECT document_id, sha256(coalesce(text, '')) AS sha256, substr(sha256(coalesce(text, '')), 1, 16) AS content_id FROM documents WHERE coalesce(text, '') <> ''")
def src4_file_hash(spark, d):
    """Hashes of files and the ids they give."""
    hashed = files.hash_files(spark, artifacts(spark, d, ".txt"))
    return hashed.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("document_id"), "sha256", F.col("document_id").alias("content_id"))


@query("SELECT document_id, sha256(CASE WHEN doc_id % 7 = 0 THEN '' ELSE coalesce(text, '') END) AS hash FROM documents")
def src6_text_artifacts(spark, d):
    """Text files read back by their paths; a seventh of the paths name no file."""
    folder = artifacts(spark, d, ".txt")
    docs = table(spark, d, "documents", "document_id", "doc_id")
    paths = docs.select("document_id", F.concat(F.lit(folder + "/"), F.when(F.col("doc_id") % 7 == 0, F.lit("none_")).otherwise(F.lit("")), "document_id", F.lit(".txt")).alias("path"))
    return files.read_texts(spark, paths, "path", folder).select("document_id", L.text_hash(F.col("text")).alias("hash"))


@query(f"""
SELECT document_id, (i + 1)::BIGINT AS page_num, length(parts[i + 1])::BIGINT AS chars, sha256(parts[i + 1]) AS hash
FROM (SELECT document_id, string_split(coalesce(text, ''), {BREAK_SQL}) AS parts FROM documents), unnest(range(len(parts))) AS t(i)""")
def src7_split_pages(spark, d):
    """Pages of every document text, without padding."""
    cut = P.explode_pages(table(spark, d, "documents", "document_id", "text"), "text")
    return cut.select("document_id", F.col("page_num").cast("bigint").alias("page_num"), F.length("page_text").cast("bigint").alias("chars"), L.text_hash(F.col("page_text")).alias("hash"))


@query(f"""
SELECT document_id, n::BIGINT AS page_num, sha256(coalesce(list_extract(string_split(coalesce(text, ''), {BREAK_SQL}), n), '')) AS hash
FROM documents, unnest(range(1, greatest(coalesce(total_pages, 0), 0) + 1)) AS t(n)""")
def src7_split_pages_padded(spark, d):
    """Pages cut or padded to the number the catalog states."""
    cut = P.explode_pages(table(spark, d, "documents", "document_id", "text", "total_pages"), "text", "total_pages")
    return cut.select("document_id", F.col("page_num").cast("bigint").alias("page_num"), L.text_hash(F.col("page_text")).alias("hash"))


@query(f"""
WITH {PAGES_SQL} SELECT run_id, document_id, sha256(string_agg(coalesce(clean_text, ''), {BREAK_SQL} ORDER BY page_num)) AS hash
FROM pages_once GROUP BY ALL""")
def snk1_join_pages(spark, d):
    joined = P.join_pages(pages_once(spark, d, "clean_text"), ["run_id", "document_id"], "clean_text")
    return joined.select("run_id", "document_id", L.text_hash(F.col("text")).alias("hash"))


NL_SQL = "chr(10)"


@query(f"""
WITH {PAGES_SQL}, s AS (SELECT *, coalesce(clean_text, '') AS body FROM pages_once),
 t AS (SELECT run_id, document_id, page_num, pipeline_version, model_used, '<!-- Page ' || page_num || ' | direction: ' || coalesce(script_direction, 'undetermined') || ' | script: ' || coalesce(primary_script, 'undetermined') || ' | tokens: ' || coalesce(token_count_cl100k::VARCHAR, '0')
  || ' | status: ' || coalesce(status, 'null') || ' -->' || {NL_SQL} || CASE WHEN script_direction = 'rtl' THEN '<div dir="rtl">' || {NL_SQL} || {NL_SQL} || body || {NL_SQL} || {NL_SQL} || '</div>'
  WHEN script_direction = 'mixed' THEN __MIXED__ ELSE body END AS section FROM s),
 m AS (SELECT run_id, document_id, '---' || {NL_SQL} || 'source: ' || min(filename) || {NL_SQL} || 'pages: ' || count(*) || {NL_SQL} || 'model: ' || coalesce(min(model_used), 'null') || {NL_SQL} || 'pipeline_version: ' || coalesce(min(pipeline_version), 'null') || {NL_SQL} || '---' || {NL_SQL}
  || string_agg(section, {NL_SQL} || {NL_SQL} || '---' || {NL_SQL} || {NL_SQL} ORDER BY page_num) AS markdown FROM t JOIN documents USING (document_id) GROUP BY run_id, document_id)
SELECT run_id, document_id, length(markdown)::BIGINT AS chars, sha256(markdown) AS hash FROM m""".replace("t JOIN documents USING", "t JOIN (SELECT document_id, filename FROM documents) d USING"))
def snk2_markdown(spark, d):
    """Markdown of every document of every run, by its hash and length."""
    rows = X.markdown_documents(table(spark, d, "pages"), table(spark, d, "documents", "document_id", "filename"))
    return rows.select("run_id", "document_id", F.length("markdown").cast("bigint").alias("chars"), L.text_hash(F.col("markdown")).alias("hash"))


JSON_FIELDS = ("pages", "total_chars", "total_words", "total_tokens", "total_time_tenths", "pages_pass", "pages_warn", "pages_fail", "pages_empty", "pages_ltr", "pages_rtl", "pages_mixed", "languages_detected", "quality_flags")


@query(f"""
WITH {PAGES_SQL}, t AS (SELECT run_id, document_id, count(*) AS pages, sum(coalesce(text_length_chars, 0))::BIGINT AS total_chars, sum(coalesce(text_length_words, 0))::BIGINT AS total_words,
 sum(coalesce(token_count_cl100k, 0))::BIGINT AS total_tokens, sum(coalesce(round(processing_time_ms * 10)::BIGINT, 0))::BIGINT AS total_time_tenths,
 {', '.join(f"count(*) FILTER (status = '{x}') AS pages_{x}" for x in R.STATUSES)}, {', '.join(f"count(*) FILTER (script_direction = '{x}') AS pages_{x}" for x in ("ltr", "rtl", "mixed"))},
 list_sort(list_distinct(flatten(list(coalesce(detected_languages, []))))) AS languages_detected, list_sort(list_distinct(flatten(list(coalesce(quality_flags, []))))) AS quality_flags FROM pages_once GROUP BY ALL)
SELECT run_id, document_id, to_json({{{', '.join(f"'{x}': {x}" for x in JSON_FIELDS)}}})::VARCHAR AS metadata FROM t""")
def snk3_metadata_json(spark, d):
    """Each document of a run with its roll-up as one JSON object."""
    totals = R.document_totals(pages_once(spark, d, "text_length_chars", "text_length_words", "token_count_cl100k", "processing_time_ms", "status", "script_direction", "detected_languages", "quality_flags"))
    return totals.select("run_id", "document_id", F.to_json(F.struct(*[c for c in totals.columns if c not in ("run_id", "document_id")])).alias("metadata"))


@query(f"""
WITH {PAGES_SQL} SELECT 'run-' || p.run_id AS dataset_export_id, p.page_id, coalesce(nullif(display_title, ''), nullif(pdf_title, '')) AS title,
 coalesce(nullif(author, ''), nullif(pdf_author, '')) AS author,
 array_to_string(CASE WHEN len({LIST_SQL.format('language')}) > 0 THEN {LIST_SQL.format('language')} ELSE coalesce(detected_languages, []) END, '|') AS language,
 coalesce(nullif(d.script, ''), nullif(p.primary_script, '')) AS script, page_num::BIGINT AS page_number, sha256(coalesce(raw_text, '')) AS raw_text_sha256,
 sha256(coalesce(clean_text, '')) AS clean_text_sha256, p.status AS validation_status, {SPLIT_SQL.format(HASH_SQL.format('file_sha256'))} AS split
FROM pages_once p JOIN documents d USING (document_id)""")
def snk4_dataset_pages(spark, d):
    rows = X.dataset_pages(table(spark, d, "pages"), table(spark, d, "documents"))
    return rows.select("dataset_export_id", "page_id", "title", "author", F.array_join("language", "|").alias("language"), "script", F.col("page_number").cast("bigint").alias("page_number"), "raw_text_sha256", "clean_text_sha256", "validation_status", "split")


@query(f"""
WITH {PAGES_SQL}, t AS (SELECT run_id, document_id, count(*) AS page_count, sum(coalesce(token_count_cl100k, 0))::BIGINT AS tokens,
  count(*) FILTER (p.status = 'pass') AS pages_pass, count(*) FILTER (p.status = 'warn') AS pages_warn, count(*) FILTER (p.status = 'fail') AS pages_fail, count(*) FILTER (p.status = 'empty') AS pages_empty,
  sha256(string_agg(coalesce(clean_text, ''), {BREAK_SQL} ORDER BY page_num)) AS clean_text_sha256 FROM pages_once p GROUP BY ALL)
SELECT run_id, document_id, filename AS document_name, page_count, tokens, pages_pass, pages_warn, pages_fail, pages_empty, clean_text_sha256,
 {SPLIT_SQL.format(HASH_SQL.format('file_sha256'))} AS split FROM t JOIN documents USING (document_id)""")
def snk4_dataset_documents(spark, d):
    rows = X.dataset_documents(table(spark, d, "pages"), table(spark, d, "documents"))
    return rows.select("run_id", "document_id", "document_name", "page_count", F.col("total_tokens_cl100k").alias("tokens"), "pages_pass", "pages_warn", "pages_fail", "pages_empty", "clean_text_sha256", "split")


@query(f"""
WITH {PAGES_SQL}, done AS (SELECT DISTINCT run_id, document_id FROM run_documents WHERE status = 'completed'),
 p AS (SELECT * FROM pages_once SEMI JOIN done USING (run_id, document_id)),
 filled AS (SELECT DISTINCT run_id, document_id FROM p WHERE length(coalesce(raw_text, '')) > 0 OR length(coalesce(clean_text, '')) > 0)
SELECT run_id, page_id AS id, page_num::BIGINT AS page, coalesce(nullif(display_title, ''), nullif(pdf_title, '')) AS title, status AS ocr_status,
 coalesce(array_to_string(quality_flags, '|'), '') AS quality_flags, sha256(coalesce(clean_text, '')) AS clean_text_sha256
FROM p SEMI JOIN filled USING (run_id, document_id) LEFT JOIN (SELECT document_id, display_title, pdf_title FROM documents) d USING (document_id)""")
def snk5_bundle_pages(spark, d):
    rows = X.bundle_pages(table(spark, d, "pages"), linked(spark, d), table(spark, d, "documents"))
    return rows.select("run_id", "id", F.col("page").cast("bigint").alias("page"), "title", "ocr_status", F.coalesce(F.array_join("quality_flags", "|"), F.lit("")).alias("quality_flags"), "clean_text_sha256")


@query()
def snk6_bundle_documents(spark, d):
    """Document rows of the text bundle with the names of their files."""
    rows = X.bundle_documents(table(spark, d, "pages"), linked(spark, d), table(spark, d, "documents"))
    return rows.select("run_id", "document_id", "title", F.array_join("language", "|").alias("language"), "page_count", "raw_file", "clean_file", "normalized_file", "normalized_text_sha256", F.array_join("quality_flags", "|").alias("quality_flags"))


@query(f"""
WITH {PAGES_SQL}, done AS (SELECT DISTINCT run_id, document_id FROM run_documents WHERE status = 'completed')
SELECT run_id, page_id AS id, 'images/' || page_id || '.png' AS image, sha256(coalesce(clean_text, '')) AS text_sha256, 'cleaned_machine_ocr' AS label_source,
 {SPLIT_SQL.format(HASH_SQL.format("coalesce(nullif(file_sha256, ''), document_id)"))} AS split
FROM pages_once SEMI JOIN done USING (run_id, document_id) LEFT JOIN (SELECT document_id, file_sha256 FROM documents) d USING (document_id)""")
def snk7_pair_rows(spark, d):
    rows = X.pair_rows(table(spark, d, "pages"), linked(spark, d), table(spark, d, "documents"))
    return rows.select("run_id", "id", "image", L.text_hash(F.col("text")).alias("text_sha256"), "label_source", "split")


@query(f"""
WITH {PAGES_SQL} SELECT run_id, count(*) AS pages_count, count(DISTINCT document_id) AS documents_count,
 count(*) FILTER (b < 90) AS train, count(*) FILTER (b >= 90 AND b < 95) AS validation, count(*) FILTER (b >= 95) AS test
FROM (SELECT run_id, document_id, {HASH_SQL.format('file_sha256')} AS b FROM pages_once JOIN documents USING (document_id)) GROUP BY run_id""")
def snk8_manifest_counts(spark, d):
    rows = pages_once(spark, d).join(table(spark, d, "documents", "document_id", "file_sha256"), "document_id").withColumn("split", L.hash_split(F.col("file_sha256")))
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("pages_count"), F.count_distinct("document_id").alias("documents_count"), *[F.count_if(F.col("split") == s).alias(s) for s, _ in L.SPLITS])


CARD_SQL = f"""
WITH {RUNDOCS_SQL}, s AS (SELECT run_id, count(*) AS documents, sum(coalesce(total_pages, 0))::BIGINT AS pages, sum(coalesce(pages_pass, 0))::BIGINT AS pages_pass,
 sum(coalesce(pages_warn, 0))::BIGINT AS pages_warn, sum(coalesce(pages_fail, 0))::BIGINT AS pages_fail, sum(coalesce(pages_empty, 0))::BIGINT AS pages_empty,
 array_to_string(list_sort(list(DISTINCT dominant_script) FILTER (coalesce(dominant_script, '') <> '')), ', ') AS scripts FROM rd GROUP BY run_id),
 l AS (SELECT run_id, array_to_string(list_sort(list(DISTINCT x)), ', ') AS languages FROM (SELECT run_id, unnest(from_json(languages_detected, '["VARCHAR"]')) AS x FROM rd) GROUP BY run_id)
SELECT s.run_id, documents, pages, pages_pass, pages_warn, pages_fail, pages_empty, coalesce(scripts, '') AS scripts, coalesce(languages, '') AS languages,
 CASE WHEN pages < 1000 THEN 'n<1K' WHEN pages < 10000 THEN '1K<n<10K' WHEN pages < 100000 THEN '10K<n<100K' WHEN pages < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS size_category
FROM s LEFT JOIN l USING (run_id)"""


@query(CARD_SQL)
def snk12_dataset_card(spark, d):
    return R.dataset_card(linked(spark, d))


_CARD_SQL = R.CARD.replace("'", "''")


@query(f"""
WITH c AS ({CARD_SQL})
SELECT run_id, printf('{_CARD_SQL}', CASE WHEN languages = '' THEN 'en' ELSE replace(languages, ', ', chr(10) || '  - ') END, size_category, run_id, coalesce(model_used, 'n/a'), coalesce(pipeline_version, 'n/a'), coalesce(strftime(coalesce(completed_at, created_at), '%Y-%m-%d'), 'n/a'),
 documents, pages, pages_pass, pages_warn, pages_fail, pages_empty, CASE WHEN scripts = '' THEN 'unknown' ELSE scripts END) AS card
FROM c JOIN (SELECT id AS run_id, model_used, pipeline_version, completed_at, created_at FROM runs) USING (run_id)""")
def snk12_card_text(spark, d):
    return R.card_text(R.dataset_card(linked(spark, d)), table(spark, d, "runs"))


@query("SELECT document_id, page_num::BIGINT AS page_num, run_id, page_id = document_id || '_page_' || lpad(page_num::VARCHAR, 4, '0') AS same FROM pages GROUP BY ALL")
def prj_page_ids(spark, d):
    p = table(spark, d, "pages", "document_id", "page_num", "run_id", "page_id").distinct()
    return p.select("document_id", F.col("page_num").cast("bigint").alias("page_num"), "run_id", (F.col("page_id") == L.page_id(F.col("document_id"), F.col("page_num"))).alias("same"))


# ---------------------------------------------------------------- profile and attempts

PROFILE_SQL = """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, t > 50 AS has_text, i > 0 AS has_images,
 CASE WHEN m > 5 OR b > 20 THEN 'complex' WHEN b > 5 OR i > 0 THEN 'moderate' ELSE 'simple' END AS complexity,
 CASE WHEN t <= 50 AND i > 0 THEN 300 ELSE 200 END::BIGINT AS dpi, t <= 50 AND i > 0 AS is_image_only
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 100) AS t, (l_suppkey % 3) AS i, (l_partkey % 31) AS b, (l_suppkey % 8) AS m FROM lineitem)"""


@query(PROFILE_SQL)
def edge2_page_profile(spark, d):
    """Page profiles over synthetic measures taken from keys."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = P.page_profile(F.col("l_partkey") % 100, F.col("l_suppkey") % 3, F.col("l_partkey") % 31, F.col("l_suppkey") % 8, F.lit(612.0), F.lit(792.0))
    return li.withColumn("p", p).select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("p.has_embedded_text").alias("has_text"), "p.has_images",
        F.col("p.estimated_complexity").alias("complexity"), F.col("p.recommended_dpi").cast("bigint").alias("dpi"), "p.is_image_only",
    )


@query("""
WITH a AS (SELECT l_orderkey AS page, l_linenumber::BIGINT AS attempt, CASE l_returnflag WHEN 'R' THEN 'fail' WHEN 'A' THEN 'warn' ELSE CASE WHEN l_linestatus = 'O' THEN 'empty' ELSE 'pass' END END AS status FROM lineitem)
SELECT page, coalesce(min(attempt) FILTER (status IN ('pass', 'warn')), max(attempt)) AS attempt,
 coalesce(arg_min(status, attempt) FILTER (status IN ('pass', 'warn')), arg_max(status, attempt)) AS status FROM a GROUP BY page""")
def edge4_retry_ladder(spark, d):
    """The attempt kept of several at each page; order lines stand for attempts."""
    flag = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_returnflag") == "A", "warn").when(F.col("l_linestatus") == "O", "empty").otherwise("pass")
    a = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("bigint").alias("attempt"), flag.alias("status"))
    return P.pick_attempt(a, ["page"], "attempt", "status").select("page", "attempt", "status")


# ---------------------------------------------------------------- filters and projections


@query("SELECT id, status, name FROM runs WHERE id = (SELECT min(id) FROM runs)")
def flt1_run_by_id(spark, d):
    runs = table(spark, d, "runs", "id", "status", "name")
    return runs.join(runs.agg(F.min("id").alias("id")), "id").select("id", "status", "name")


@query("SELECT document_id, filename FROM documents WHERE file_sha256 = (SELECT max(file_sha256) FROM documents)")
def flt1_document_by_hash(spark, d):
    docs = table(spark, d, "documents", "document_id", "filename", "file_sha256")
    return docs.join(docs.agg(F.max("file_sha256").alias("file_sha256")), "file_sha256").select("document_id", "filename")


@query("SELECT id, status FROM runs WHERE status IN ('queued', 'processing')")
def flt2_open_runs(spark, d):
    return table(spark, d, "runs", "id", "status").filter(F.col("status").isin(*K.OPEN))


@query("SELECT DISTINCT run_id, document_id FROM run_documents WHERE status = 'completed'")
def flt3_completed(spark, d):
    return table(spark, d, "run_documents", "run_id", "document_id", "status").filter("status = 'completed'").select("run_id", "document_id").distinct()


@query("SELECT min(document_id) AS document_id FROM (SELECT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM run_documents WHERE status = 'failed'))")
def flt4_missing_selection(spark, d):
    """The least catalog id that no failed link holds."""
    failed = table(spark, d, "run_documents", "document_id", "status").filter("status = 'failed'")
    return K.missing(table(spark, d, "documents", "document_id"), failed, "document_id").agg(F.min("document_id").alias("document_id"))


@query("SELECT DISTINCT run_id, document_id FROM pages WHERE length(coalesce(raw_text, '')) > 0 OR length(coalesce(clean_text, '')) > 0")
def flt5_with_text(spark, d):
    p = table(spark, d, "pages", "run_id", "document_id", "raw_text", "clean_text")
    return p.filter((F.coalesce(F.length("raw_text"), F.lit(0)) > 0) | (F.coalesce(F.length("clean_text"), F.lit(0)) > 0)).select("run_id", "document_id").distinct()


@query("SELECT document_id FROM documents WHERE " + " OR ".join(f"contains(lower(coalesce({c}, '')), 'mekt')" for c in K.SEARCHED))
def flt6_search(spark, d):
    return K.search(table(spark, d, "documents", "document_id", *K.SEARCHED), "Mekt ").select("document_id")


@query("SELECT document_id FROM documents WHERE trim(coalesce(group_path, '')) = 'Tarih/Salname' AND (" + " OR ".join(f"contains(lower(coalesce({c}, '')), 'defter')" for c in K.SEARCHED) + ")")
def flt6_search_in_group(spark, d):
    return K.search(table(spark, d, "documents", "document_id", *K.SEARCHED), "defter", "Tarih/Salname").select("document_id")


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, document_id, rd.status, source_path FROM rd JOIN documents USING (document_id)
WHERE rd.status <> 'completed' AND coalesce(source_path, '') <> '' AND run_id IN (SELECT id FROM runs WHERE status = 'failed')""")
def flt7_retryable(spark, d):
    rows = K.retryable(table(spark, d, "runs"), linked(spark, d), table(spark, d, "documents", "document_id", "source_path"))
    return rows.select("run_id", "document_id", "status", "source_path")


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, arg_min(document_id, (coalesce(started_at, TIMESTAMP '9999-01-01'), document_id)) AS document_id FROM rd WHERE status = 'processing' GROUP BY run_id""")
def flt8_first_in_flight(spark, d):
    rows = linked(spark, d).filter("status = 'processing'")
    late = F.coalesce("started_at", F.lit("9999-01-01").cast("timestamp"))
    return rows.groupBy("run_id").agg(F.min_by("document_id", F.struct(late, "document_id")).alias("document_id"))


@query(f"""
WITH {RUNDOCS_SQL}, p AS (SELECT run_id, document_id, status, row_number() OVER (PARTITION BY run_id ORDER BY started_at NULLS LAST, document_id) AS position,
 CASE WHEN status = 'processing' THEN 0 WHEN status IN ('pending', 'queued') THEN 1 WHEN status = 'failed' THEN 2 ELSE 3 END AS r FROM rd)
SELECT run_id, document_id, status, position FROM p QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY r, CASE WHEN r < 3 THEN position ELSE -position END) = 1""")
def flt9_current_document(spark, d):
    rows = linked(spark, d)
    return K.current_document(rows).select("run_id", "document_id", "status", F.col("position").cast("bigint").alias("position"))


@query("""
SELECT document_id, coalesce(nullif(display_title, ''), nullif(pdf_title, ''), filename) AS title,
 CASE WHEN """ + " AND ".join(f"coalesce({c}, '') <> ''" for c in K.COMPLETE) + " THEN 1 ELSE 0 END::BIGINT AS complete FROM documents")
def prj1_titles_and_completeness(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("document_id", K.display_title().alias("title"), K.metadata_complete().cast("bigint").alias("complete"))


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, document_id, coalesce(total_pages, 0)::BIGINT AS total_pages, coalesce(pages_pass, 0)::BIGINT AS pages_pass,
 coalesce(total_tokens_cl100k, 0)::BIGINT AS tokens, coalesce(total_processing_time_ms, 0.0)::DOUBLE AS ms FROM rd""")
def prj3_row_defaults(spark, d):
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return linked(spark, d).select("run_id", "document_id", zero("total_pages").alias("total_pages"), zero("pages_pass").alias("pages_pass"), zero("total_tokens_cl100k").alias("tokens"), F.coalesce("total_processing_time_ms", F.lit(0.0)).alias("ms"))


PRJ4 = ("document_id", "filename", "source_path", "file_sha256", "total_pages", "pdf_title", "display_title", "group_path", "author", "work", "language", "license", "notes", "tags_json")


@query("SELECT " + ", ".join(f"{c}::BIGINT AS {c}" if c == "total_pages" else c for c in PRJ4) + " FROM documents")
def prj4_document_columns(spark, d):
    return table(spark, d, "documents", *PRJ4).withColumn("total_pages", F.col("total_pages").cast("bigint"))


LATEST_SQL = """latest AS (SELECT rd.document_id, arg_max(r.id, (r.created_at, r.id)) AS latest_run_id, arg_max(r.status, (r.created_at, r.id)) AS latest_run_status
 FROM (SELECT DISTINCT run_id, document_id FROM run_documents) rd JOIN runs r ON r.id = rd.run_id GROUP BY rd.document_id)"""


@query(f"""
WITH {LATEST_SQL} SELECT document_id, latest_run_id, CASE WHEN latest_run_status = 'completed' THEN 'processed' WHEN latest_run_status IN ('queued', 'processing') THEN 'running'
 WHEN latest_run_status = 'failed' THEN 'failed' ELSE 'never' END AS label FROM (SELECT document_id FROM documents) LEFT JOIN latest USING (document_id)""")
def prj6_process_labels(spark, d):
    latest = K.latest_runs(table(spark, d, "run_documents", "document_id", "run_id"), table(spark, d, "runs", "id", "created_at", "status"))
    docs = table(spark, d, "documents", "document_id").join(latest, "document_id", "left")
    return docs.select("document_id", "latest_run_id", K.process_label(F.col("latest_run_status")).alias("label"))


@query(f"WITH {PAGES_SQL} SELECT run_id, page_id, NOT coalesce(has_embedded_text, false) AND coalesce(is_image_only, false) AS image_only FROM pages_once")
def prj9_image_only(spark, d):
    p = pages_once(spark, d, "page_id", "has_embedded_text", "is_image_only")
    return p.select("run_id", "page_id", (~F.coalesce("has_embedded_text", F.lit(False)) & F.coalesce("is_image_only", F.lit(False))).alias("image_only"))


PILLS_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.RUN_PILLS.items()) + " ELSE 'pill-muted' END"
CLASSES_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PAGE_CLASSES.items()) + " ELSE 'page-pending' END"


@query(f"SELECT 'run' AS kind, id, {PILLS_SQL.format('status')} AS shown FROM runs UNION SELECT 'page', page_id, {CLASSES_SQL.format('status')} FROM pages")
def prj7_status_classes(spark, d):
    """How the status of every run and page is shown."""
    runs = table(spark, d, "runs", "id", "status").select(F.lit("run").alias("kind"), "id", L.shown_as(F.col("status"), L.RUN_PILLS, "pill-muted").alias("shown"))
    pages = table(spark, d, "pages", "page_id", "status").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), L.shown_as(F.col("status"), L.PAGE_CLASSES, "page-pending").alias("shown"))
    return runs.unionByName(pages).distinct()


# ---------------------------------------------------------------- joins


@query(f"WITH {RUNDOCS_SQL} SELECT run_id, document_id, rd.status, filename, file_sha256 FROM rd JOIN documents USING (document_id)")
def jn1_run_documents(spark, d):
    return linked(spark, d).select("run_id", "document_id", "status").join(table(spark, d, "documents", "document_id", "filename", "file_sha256"), "document_id").select("run_id", "document_id", "status", "filename", "file_sha256")


@query(f"WITH {RUNDOCS_SQL} SELECT document_id, run_id, runs.name, runs.status AS run_status, epoch_us(runs.created_at) AS created_at FROM rd JOIN runs ON runs.id = rd.run_id")
def jn2_document_history(spark, d):
    runs = table(spark, d, "runs", "id", "name", "status", "created_at").select(F.col("id").alias("run_id"), "name", F.col("status").alias("run_status"), "created_at")
    return linked(spark, d).select("document_id", "run_id").join(runs, "run_id").select("document_id", "run_id", "name", "run_status", micros("created_at"))


@query(f"WITH {LATEST_SQL} SELECT * FROM latest")
def jn3_latest_run(spark, d):
    return K.latest_runs(table(spark, d, "run_documents", "document_id", "run_id"), table(spark, d, "runs", "id", "created_at", "status"))


@query(f"""
WITH cut AS (SELECT document_id, (i + 1) AS page_num, parts[i + 1] AS page_text FROM (SELECT document_id, string_split(coalesce(text, ''), {BREAK_SQL}) AS parts FROM documents), unnest(range(len(parts))) AS t(i)),
 m AS (SELECT document_id, page_num, max(status) AS status, max(dpi_used)::BIGINT AS dpi FROM pages GROUP BY ALL)
SELECT document_id, page_num::BIGINT AS page_num, length(page_text)::BIGINT AS chars, status, dpi FROM cut LEFT JOIN m USING (document_id, page_num)""")
def jn4_page_text_with_metrics(spark, d):
    cut = P.explode_pages(table(spark, d, "documents", "document_id", "text"), "text")
    m = table(spark, d, "pages", "document_id", "page_num", "status", "dpi_used").groupBy("document_id", "page_num").agg(F.max("status").alias("status"), F.max("dpi_used").cast("bigint").alias("dpi"))
    return cut.join(m, ["document_id", "page_num"], "left").select("document_id", F.col("page_num").cast("bigint").alias("page_num"), F.length("page_text").cast("bigint").alias("chars"), "status", "dpi")


@query("SELECT document_id, total_pages::BIGINT AS total_pages, least(len(string_split(coalesce(text, ''), chr(10) || chr(12) || chr(10))), greatest(coalesce(total_pages, 0), 0))::BIGINT AS zipped FROM documents")
def jn6_zip_length(spark, d):
    """How many pages a zip of the cut text with the stated number of pages yields."""
    docs = table(spark, d, "documents", "document_id", "text", "total_pages")
    parts = P.split_pages(F.col("text"))
    z = F.size(F.slice(parts, 1, F.greatest(F.coalesce("total_pages", F.lit(0)), F.lit(0))))
    return docs.select("document_id", F.col("total_pages").cast("bigint").alias("total_pages"), z.cast("bigint").alias("zipped"))


@query(f"WITH {RUNDOCS_SQL} SELECT run_id, document_id, status FROM rd WHERE run_id IN (SELECT id FROM runs WHERE status = 'failed')")
def jn8_documents_of_failed_runs(spark, d):
    failed = table(spark, d, "runs", "id", "status").filter("status = 'failed'").select(F.col("id").alias("run_id"))
    return linked(spark, d).select("run_id", "document_id", "status").join(failed, "run_id", "left_semi")


@query("SELECT DISTINCT document_id FROM documents WHERE document_id NOT IN (SELECT document_id FROM pages WHERE status = 'fail')")
def jn9_missing_ids(spark, d):
    """Documents none of whose pages failed."""
    return K.missing(table(spark, d, "documents", "document_id"), table(spark, d, "pages", "document_id", "status").filter("status = 'fail'"), "document_id")


@query("""
WITH x AS (SELECT max(id) AS id FROM runs WHERE status <> 'processing'), l AS (SELECT 'runs' AS name, id AS run_id FROM runs UNION ALL SELECT 'run_documents', run_id FROM run_documents UNION ALL SELECT 'pages', run_id FROM pages UNION ALL SELECT 'run_events', run_id FROM run_events)
SELECT name, run_id, count(*) AS n FROM l WHERE run_id <> (SELECT id FROM x) GROUP BY ALL""")
def jn10_cascade_delete(spark, d):
    """Rows left of each run in four tables after the greatest idle run is deleted."""
    runs = table(spark, d, "runs")
    gone = runs.filter("status <> 'processing'").agg(F.max("id")).first()[0]
    names = ("runs", "run_documents", "pages", "run_events")
    left = K.delete_run(gone, runs, *[table(spark, d, n) for n in names[1:]])
    counts = [t.groupBy(F.col("id" if n == "runs" else "run_id").alias("run_id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "run_id", "n") for n, t in zip(names, left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# ---------------------------------------------------------------- aggregates

TOTALS = ("text_length_chars", "text_length_words", "token_count_cl100k", "processing_time_ms", "status", "script_direction", "detected_languages", "quality_flags")


@query(f"""
WITH {PAGES_SQL} SELECT run_id, document_id, count(*) AS pages, sum(coalesce(text_length_chars, 0))::BIGINT AS total_chars, sum(coalesce(text_length_words, 0))::BIGINT AS total_words,
 sum(coalesce(token_count_cl100k, 0))::BIGINT AS total_tokens, sum(coalesce(round(processing_time_ms * 10)::BIGINT, 0))::BIGINT AS total_time_tenths,
 count(*) FILTER (status = 'pass') AS pages_pass, count(*) FILTER (status = 'warn') AS pages_warn, count(*) FILTER (status = 'fail') AS pages_fail, count(*) FILTER (status = 'empty') AS pages_empty,
 count(*) FILTER (script_direction = 'ltr') AS pages_ltr, count(*) FILTER (script_direction = 'rtl') AS pages_rtl, count(*) FILTER (script_direction = 'mixed') AS pages_mixed
FROM pages_once GROUP BY ALL""")
def ag1_document_totals(spark, d):
    return R.document_totals(pages_once(spark, d, *TOTALS)).drop("languages_detected", "quality_flags")


def _dominant_sql(column: str, out: str, default: str) -> str:
    return f"""
WITH {PAGES_SQL}, c AS (SELECT run_id, document_id, {column} AS v, count(*) AS n, min(page_num) AS f FROM pages_once WHERE {column} IS NOT NULL GROUP BY ALL),
 b AS (SELECT run_id, document_id, arg_max(v, (n, -f)) AS v FROM c GROUP BY ALL)
SELECT run_id, document_id, coalesce(v, '{default}') AS {out} FROM (SELECT DISTINCT run_id, document_id FROM pages_once) LEFT JOIN b USING (run_id, document_id)"""


@query(_dominant_sql("primary_script", "dominant_script", "unknown"))
def ag4_dominant_script(spark, d):
    return R.dominant(pages_once(spark, d, "primary_script"), ["run_id", "document_id"], "primary_script", "page_num", "dominant_script", "unknown")


@query(_dominant_sql("script_direction", "dominant_direction", "ltr"))
def ag4_dominant_direction(spark, d):
    return R.dominant(pages_once(spark, d, "script_direction"), ["run_id", "document_id"], "script_direction", "page_num", "dominant_direction", "ltr")


def _items_sql(column: str, out: str) -> str:
    return f"""
WITH {PAGES_SQL} SELECT run_id, document_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce({column}, []))))), '|'), '') AS {out} FROM pages_once GROUP BY ALL"""


@query(_items_sql("detected_languages", "languages"))
def ag5_languages(spark, d):
    p = pages_once(spark, d, "detected_languages")
    return p.groupBy("run_id", "document_id").agg(F.array_join(R.distinct_items(F.col("detected_languages")), "|").alias("languages"))


@query(_items_sql("quality_flags", "flags"))
def ag8_quality_flags(spark, d):
    p = pages_once(spark, d, "quality_flags")
    return p.groupBy("run_id", "document_id").agg(F.array_join(R.distinct_items(F.col("quality_flags")), "|").alias("flags"))


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, count(*) AS documents, sum(coalesce(pages_pass, 0))::BIGINT AS pages_pass, sum(coalesce(pages_warn, 0))::BIGINT AS pages_warn,
 sum(coalesce(pages_fail, 0))::BIGINT AS pages_fail, sum(coalesce(pages_empty, 0))::BIGINT AS pages_empty, sum(coalesce(total_pages, 0))::BIGINT AS pages_total_estimate,
 sum(coalesce(round(total_processing_time_ms * 10)::BIGINT, 0))::BIGINT AS total_time_tenths FROM rd GROUP BY run_id""")
def ag6_run_totals(spark, d):
    return R.run_totals(linked(spark, d))


@query("SELECT coalesce(nullif(trim(group_path), ''), 'Ungrouped') AS name, count(*) AS documents, min(doc_id) AS first_document FROM documents GROUP BY 1")
def ag9_grouped_documents(spark, d):
    docs = table(spark, d, "documents", "doc_id", "group_path")
    return docs.groupBy(K.group_name().alias("name")).agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_document"))


@query("SELECT DISTINCT trim(group_path) AS name FROM documents WHERE trim(coalesce(group_path, '')) <> ''")
def ag10_available_groups(spark, d):
    return table(spark, d, "documents", "group_path").select(L.filled(F.trim("group_path")).alias("name")).dropna().distinct()


@query(f"""
WITH {RUNDOCS_SQL} SELECT r.id AS run_id, greatest(0, least(100, round(coalesce(r.progress, 0) * 100)))::BIGINT AS percent, coalesce(sum(pages_warn), 0)::BIGINT AS warn, coalesce(sum(pages_fail), 0)::BIGINT AS fail
FROM runs r LEFT JOIN rd ON rd.run_id = r.id GROUP BY r.id, r.progress""")
def ag11_console_stats(spark, d):
    sums = linked(spark, d).groupBy("run_id").agg(F.sum("pages_warn").alias("warn"), F.sum("pages_fail").alias("fail"))
    runs = table(spark, d, "runs", "id", "progress").select(F.col("id").alias("run_id"), "progress").join(sums, "run_id", "left")
    percent = F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.coalesce("progress", F.lit(0.0)) * 100)))
    return runs.select("run_id", percent.cast("bigint").alias("percent"), F.coalesce("warn", F.lit(0)).cast("bigint").alias("warn"), F.coalesce("fail", F.lit(0)).cast("bigint").alias("fail"))


COUNTERS_SQL = """
WITH e AS (SELECT * FROM run_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id) = 1)
SELECT count(*) FILTER (event_type = 'run_started') AS jobs_created, count(*) FILTER (event_type = 'run_complete') AS jobs_completed, count(*) FILTER (event_type = 'run_failed') AS jobs_failed,
 greatest(0, count(*) FILTER (event_type = 'run_started') - count(*) FILTER (event_type IN ('run_complete', 'run_failed')))::BIGINT AS active_jobs,
 count(*) FILTER (event_type = 'document_complete') AS documents_processed, count(*) FILTER (event_type = 'page_retry') AS page_retries FROM e"""


@query(COUNTERS_SQL)
def ag12_counters(spark, d):
    return E.counters(E.once(table(spark, d, "run_events"))).select("jobs_created", "jobs_completed", "jobs_failed", F.col("active_jobs").cast("bigint").alias("active_jobs"), "documents_processed", "page_retries")


@query(f"""
WITH {PAGES_SQL}, s AS (SELECT run_id, count(*) AS pages, sum(greatest(coalesce(token_count_cl100k, 0), 0))::BIGINT AS tokens, sum(coalesce(round(processing_time_ms * 10)::BIGINT, 0))::BIGINT AS tenths FROM pages_once GROUP BY run_id)
SELECT run_id, pages, tokens, CASE WHEN tenths > 0 THEN floor(tokens * 10000000 / tenths)::BIGINT ELSE 0 END AS tokens_per_1000_s, CASE WHEN pages > 0 THEN floor(tenths / pages)::BIGINT ELSE 0 END AS latency_tenths FROM s""")
def ag13_rates(spark, d):
    """Tokens in a thousand seconds and tenths of a millisecond per page, as whole numbers."""
    s = pages_once(spark, d, "token_count_cl100k", "processing_time_ms").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.greatest(F.coalesce("token_count_cl100k", F.lit(0)), F.lit(0))).alias("tokens"), F.sum(F.coalesce(F.round(F.col("processing_time_ms") * 10).cast("bigint"), F.lit(0))).alias("tenths"),
    )
    return s.select(
        "run_id", "pages", "tokens", F.when(F.col("tenths") > 0, F.expr("tokens * 10000000 div tenths")).otherwise(F.lit(0)).cast("bigint").alias("tokens_per_1000_s"),
        F.when(F.col("pages") > 0, F.expr("tenths div pages")).otherwise(F.lit(0)).cast("bigint").alias("latency_tenths"),
    )


# ---------------------------------------------------------------- windows, order, sets


@query(f"""
WITH l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, {lines_sql("coalesce(text, '')")} AS x FROM documents), unnest(range(1, len(x) + 1)) AS t(i)),
 g AS (SELECT doc_id, line, i - row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS island FROM l)
SELECT doc_id, max(n)::BIGINT AS longest FROM (SELECT doc_id, line, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id""")
def wn1_longest_run(spark, d):
    """The longest row of equal neighbouring lines of every document with lines."""
    lines = text_lines(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", longest_run(lines).cast("bigint").alias("longest")).filter("longest > 0")


@query("SELECT id, epoch_us(created_at) AS created_at FROM runs ORDER BY runs.created_at DESC NULLS LAST, id LIMIT 50")
def so1_newest_runs(spark, d):
    return K.newest(table(spark, d, "runs", "id", "created_at"), "created_at", "id", 50).select("id", micros("created_at"))


@query("SELECT document_id, epoch_us(last_seen_at) AS last_seen_at FROM documents ORDER BY documents.last_seen_at DESC NULLS LAST, document_id LIMIT 500")
def so2_newest_documents(spark, d):
    return K.newest(table(spark, d, "documents", "document_id", "last_seen_at"), "last_seen_at", "document_id", 500).select("document_id", micros("last_seen_at"))


@query(f"WITH {RUNDOCS_SQL} SELECT run_id, document_id, row_number() OVER (PARTITION BY run_id ORDER BY started_at NULLS LAST, document_id) AS position FROM rd")
def so3_unstarted_last(spark, d):
    return ordered_rank(linked(spark, d).select("run_id", "document_id", "started_at"), ["run_id"], K.started_order(), "position").select("run_id", "document_id", "position")


@query(f"WITH {PAGES_SQL} SELECT run_id, document_id, array_to_string(list(page_num ORDER BY page_num), ',') AS pages FROM pages_once GROUP BY ALL")
def so4_pages_in_order(spark, d):
    return pages_once(spark, d).groupBy("run_id", "document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page_num")), lambda x: x.cast("string")), ",").alias("pages"))


@query("SELECT DISTINCT id, run_id, event_type FROM run_events WHERE id > 100 ORDER BY id LIMIT 1000")
def so5_keyset_page(spark, d):
    return E.once(table(spark, d, "run_events", "id", "run_id", "event_type").filter("id > 100")).orderBy("id").limit(1000)


@query("""
WITH s AS (SELECT run_id, list(DISTINCT document_id) AS a FROM run_documents GROUP BY run_id), c AS (SELECT run_id, list(DISTINCT document_id) AS b FROM run_documents WHERE status = 'completed' GROUP BY run_id)
SELECT run_id, len(a)::BIGINT AS all_documents, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x)))::BIGINT AS unfinished, len(list_filter(a, lambda x: NOT list_contains(coalesce(b, []), x))) = 0 AS complete FROM s LEFT JOIN c USING (run_id)""")
def st1_selection_sets(spark, d):
    return K.selection_state(table(spark, d, "run_documents", "run_id", "document_id", "status"))


# ---------------------------------------------------------------- changes


@query("""
WITH i AS (SELECT CASE WHEN doc_id % 20 = 4 THEN 'n' || document_id ELSE document_id END AS document_id, 'new_' || filename AS filename, source_path || '.bak' AS source_path, file_size_bytes + 1 AS file_size_bytes, CASE WHEN doc_id % 2 = 0 THEN total_pages + 1 END AS total_pages FROM documents WHERE doc_id % 20 < 5)
SELECT document_id, CASE WHEN i.document_id IS NULL THEN d.filename ELSE i.filename END AS filename, CASE WHEN i.document_id IS NULL THEN d.source_path ELSE i.source_path END AS source_path, CASE WHEN i.document_id IS NULL THEN d.file_size_bytes ELSE i.file_size_bytes END::BIGINT AS file_size_bytes,
 coalesce(i.total_pages, d.total_pages)::BIGINT AS total_pages, d.display_title, epoch_us(CASE WHEN d.document_id IS NULL THEN TIMESTAMPTZ '2030-01-01 00:00:00+00' ELSE d.first_seen_at END) AS first_seen_at FROM documents d FULL JOIN i USING (document_id)""")
def dm1_upsert_documents(spark, d):
    """A quarter of the files seen again, and of each twentieth document a new one."""
    docs = table(spark, d, "documents")
    incoming = docs.filter("doc_id % 20 < 5").select(
        F.when(F.col("doc_id") % 20 == 4, F.concat(F.lit("n"), "document_id")).otherwise(F.col("document_id")).alias("document_id"), F.concat(F.lit("new_"), "filename").alias("filename"), F.concat("source_path", F.lit(".bak")).alias("source_path"),
        (F.col("file_size_bytes") + 1).alias("file_size_bytes"), F.when(F.col("doc_id") % 2 == 0, F.col("total_pages") + 1).alias("total_pages"), F.lit("2030-01-01 00:00:00+00:00").cast("timestamp").alias("last_seen_at"),
        *[F.lit(None).cast("string").alias(c) for c in K.UPSERT_KEEPS_OLD if c != "total_pages"],
    )
    return K.upsert_documents(docs, incoming).select("document_id", "filename", "source_path", "file_size_bytes", F.col("total_pages").cast("bigint").alias("total_pages"), "display_title", micros("first_seen_at"))


@query(f"""
WITH {RUNDOCS_SQL}, i AS (SELECT run_id, document_id FROM rd WHERE status = 'pending' UNION SELECT 'new_run', document_id FROM rd WHERE status = 'failed')
SELECT run_id, document_id, CASE WHEN i.run_id IS NOT NULL THEN 'queued' ELSE rd.status END AS status, CASE WHEN i.run_id IS NOT NULL THEN 'again' ELSE source_run_id END AS source_run_id FROM rd FULL JOIN i USING (run_id, document_id)""")
def dm2_link_documents(spark, d):
    """Pending links queued again, and a new run of the failed ones."""
    rd = linked(spark, d)
    again = rd.filter("status = 'pending'").select("run_id", "document_id").unionByName(rd.filter("status = 'failed'").select(F.lit("new_run").alias("run_id"), "document_id").distinct())
    return K.link_run_documents(rd, again.select("run_id", "document_id", F.lit("queued").alias("status"), F.lit("again").alias("source_run_id"))).select("run_id", "document_id", "status", "source_run_id")


@query(f"""
WITH {PAGES_SQL} SELECT run_id, document_id, page_num::BIGINT AS page_num, CASE WHEN status = 'fail' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'fail' THEN NULL ELSE dpi_used END::BIGINT AS dpi_used,
 CASE WHEN status = 'fail' THEN 'retry' ELSE extraction_mode END AS extraction_mode FROM pages_once UNION ALL SELECT run_id, document_id, page_num + 100000, 'pending', NULL, 'retry' FROM pages_once WHERE status = 'warn'""")
def dm3_upsert_pages(spark, d):
    """Failed pages replaced, and for each with a warning a new one."""
    p = pages_once(spark, d, "status", "dpi_used", "extraction_mode")
    incoming = p.filter("status in ('fail', 'warn')").select("run_id", "document_id", F.when(F.col("status") == "warn", F.col("page_num") + 100000).otherwise(F.col("page_num")).alias("page_num"), F.lit("retry").alias("extraction_mode"))
    return K.upsert_pages(p, incoming).select("run_id", "document_id", F.col("page_num").cast("bigint").alias("page_num"), "status", F.col("dpi_used").cast("bigint").alias("dpi_used"), "extraction_mode")


@query("""
WITH t AS (SELECT min(document_id) AS lo, max(document_id) AS hi FROM documents)
SELECT document_id, CASE WHEN document_id IN (lo, hi) THEN 'New/Group' ELSE group_path END AS group_path, CASE WHEN document_id IN (lo, hi) THEN NULL ELSE license END AS license, filename FROM documents, t""")
def dm5_bulk_patch(spark, d):
    docs = table(spark, d, "documents", "document_id", "group_path", "license", "filename", "catalog_updated_at")
    ids = list(docs.agg(F.min("document_id"), F.max("document_id")).first())
    return K.patch_documents(docs, ids, {"group_path": "New/Group", "license": None, "filename": "ignored"}, F.current_timestamp()).drop("catalog_updated_at")


@query("""
SELECT id, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status, CASE WHEN status IN ('queued', 'processing') THEN 'failed' ELSE stage END AS stage,
 CASE WHEN status IN ('queued', 'processing') THEN coalesce(error, 'Process exited before run finished') ELSE error END AS error, completed_at IS NULL AND status NOT IN ('queued', 'processing') AS unfinished FROM runs""")
def dm6_orphan_sweep(spark, d):
    runs, _ = K.sweep_orphans(table(spark, d, "runs"), linked(spark, d), F.current_timestamp())
    return runs.select("id", "status", "stage", "error", F.col("completed_at").isNull().alias("unfinished"))


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, document_id, CASE WHEN rd.status <> 'completed' AND run_id IN (SELECT id FROM runs WHERE status IN ('queued', 'processing')) THEN 'failed' ELSE rd.status END AS status FROM rd""")
def dm6_orphan_sweep_documents(spark, d):
    _, links = K.sweep_orphans(table(spark, d, "runs"), linked(spark, d), F.current_timestamp())
    return links.select("run_id", "document_id", "status")


@query(f"""
WITH {RUNDOCS_SQL} SELECT run_id, document_id, CASE WHEN rd.status <> 'completed' AND run_id IN (SELECT id FROM runs WHERE status = 'failed') THEN 'failed' ELSE rd.status END AS status FROM rd""")
def dm7_failed_run_sweep(spark, d):
    return K.sweep_failed_runs(table(spark, d, "runs"), linked(spark, d), F.current_timestamp()).select("run_id", "document_id", "status")


@query("""
SELECT doc_id, doc_id % 3 <> 0 AS deduped, CASE WHEN doc_id % 3 <> 0 THEN filename ELSE 'up_' || filename END AS filename FROM documents""")
def dm10_dedup_uploads(spark, d):
    """Two of three files come again under another name; the others are new by content."""
    docs = table(spark, d, "documents", "doc_id", "filename", "file_sha256")
    sha = F.when(F.col("doc_id") % 3 == 0, F.sha2("file_sha256", 256)).otherwise(F.col("file_sha256"))
    return K.dedup_uploads(docs.select("doc_id", F.concat(F.lit("up_"), "filename").alias("filename"), sha.alias("file_sha256")), docs).select("doc_id", "deduped", "filename")


@query("SELECT id, status, CASE WHEN documents_total > 40 THEN 'large' ELSE name END AS name, CASE WHEN documents_total > 40 THEN coalesce(progress, 0.0) + 1.0 ELSE progress END AS progress FROM runs")
def dm8_generic_update(spark, d):
    """Some columns of the rows that meet a condition."""
    runs = table(spark, d, "runs", "id", "status", "name", "progress", "documents_total")
    return K.update_rows(runs, F.col("documents_total") > 40, name="large", progress=F.coalesce("progress", F.lit(0.0)) + 1.0).drop("documents_total")


# ---------------------------------------------------------------- text


@query("SELECT run_id, page_id, sha256(coalesce(nfc_normalize(clean_text), '')) AS hash FROM pages GROUP BY ALL")
def tx1_compose(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    return p.select("run_id", "page_id", L.text_hash(C.compose("clean_text")).alias("hash")).distinct()


MARKERS_SQL = "coalesce(raw_text, '')"
MARKERS_SQL = f"regexp_replace({MARKERS_SQL}, '<\\|ref\\|>.*?<\\|/ref\\|>[{SPACE_SQL}]*<\\|det\\|>[{SPACE_SQL}]*\\[\\[.*?\\]\\][{SPACE_SQL}]*<\\|/det\\|>[{SPACE_SQL}]*', '', 'gs')"
MARKERS_SQL = f"regexp_replace({MARKERS_SQL}, '<\\|ref\\|>(.*?)<\\|/ref\\|>[{SPACE_SQL}]*\\[\\[[\\p{{Nd}}{SPACE_SQL},]+\\]\\]', '\\1', 'gs')"
for _token in C.MODEL_TOKENS:
    MARKERS_SQL = f"replace({MARKERS_SQL}, '{_token}', '')"
MARKERS_SQL = f"regexp_replace({MARKERS_SQL}, '<\\|/?[a-z_]+\\|>|\\x00', '', 'g')"


@query(f"SELECT run_id, page_id, sha256({MARKERS_SQL}) AS hash FROM pages GROUP BY ALL")
def tx2_tx4_markers(spark, d):
    """References, model tokens and null characters dropped from the raw text of every page."""
    p = table(spark, d, "pages", "run_id", "page_id", "raw_text")
    return p.select("run_id", "page_id", L.text_hash(C.clean_markers(F.coalesce("raw_text", F.lit("")))).alias("hash")).distinct()


CELLS_SQL = f"array_to_string(list_filter(list_transform(string_split(l, ' '), lambda c: trim(regexp_replace(regexp_replace(c, '</?(?:{C.CLEAN_TAGS})\\b[^>]*>', '', 'gi'), '[{SPACE_SQL}]+', ' ', 'g'))), lambda c: c <> ''), ' | ')"


@query(f"""
SELECT run_id, page_id, sha256(array_to_string(list_filter(list_transform({lines_sql("coalesce(clean_text, '')")}, lambda l: {CELLS_SQL}), lambda r: r <> ''), chr(10))) AS hash
FROM (SELECT DISTINCT run_id, page_id, clean_text FROM pages)""")
def tx5_tables(spark, d):
    """Tables made of the lines of every page, and back to lines of cells."""
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    cells = F.concat(F.lit("<tr><td>"), F.array_join(F.transform(text_lines(F.coalesce("clean_text", F.lit(""))), lambda x: F.replace(x, F.lit(" "), F.lit("</td><td>"))), "</td></tr>\n<tr><td>"), F.lit("</td></tr>"))
    made = p.withColumn("markup", F.concat(F.lit("<table border=1>"), cells, F.lit("</table>")))
    return made.select("run_id", "page_id", L.text_hash(C.tables_to_lines("markup")).alias("hash")).distinct()


TAGS_SQL = f"regexp_replace(regexp_replace(regexp_replace(t, '<br[{SPACE_SQL}]*/?>', chr(10), 'gi'), '</(?:p|div|h[1-6])[{SPACE_SQL}]*>', chr(10), 'gi'), '</?(?:{C.CLEAN_TAGS})\\b[^>]*>', '', 'gi')"


@query(f"SELECT run_id, page_id, sha256({TAGS_SQL}) AS hash FROM (SELECT DISTINCT run_id, page_id, '<DIV class=x>' || replace(coalesce(clean_text, ''), chr(10), '<br />') || '</p></Center>' AS t FROM pages)")
def tx6_tags(spark, d):
    """Tags put into every page, then dropped."""
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    made = F.concat(F.lit("<DIV class=x>"), F.replace(F.coalesce("clean_text", F.lit("")), F.lit("\n"), F.lit("<br />")), F.lit("</p></Center>"))
    return p.select("run_id", "page_id", L.text_hash(C.drop_tags(made)).alias("hash")).distinct()


@query("SELECT run_id, page_id, sha256(coalesce(clean_text, '')) AS hash FROM pages GROUP BY ALL")
def tx7_unescape(spark, d):
    """Every page escaped and unescaped again."""
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    made = F.coalesce("clean_text", F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("ü", "&uuml;"), ("ç", "&#xe7;")):
        made = F.replace(made, F.lit(a), F.lit(b))
    return p.select("run_id", "page_id", L.text_hash(C.unescape(made)).alias("hash")).distinct()


@query(r"SELECT run_id, page_id, sha256(regexp_replace(coalesce(raw_text, ''), '([\p{L}\p{N}_])- ?\n([\p{L}\p{N}_])', '\1\2', 'g')) AS hash FROM pages GROUP BY ALL")
def tx8_join_divided(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "raw_text")
    return p.select("run_id", "page_id", L.text_hash(C.join_divided(F.coalesce("raw_text", F.lit("")))).alias("hash")).distinct()


TIDY_SQL = "regexp_replace(coalesce(raw_text, ''), '\\n{3,}', chr(10) || chr(10), 'g')"
TIDY_SQL = f"array_to_string(list_transform(string_split({TIDY_SQL}, chr(10)), lambda x: regexp_replace(x, '[{SPACE_SQL}]+$', '')), chr(10))"
for _a, _b in C.MISPRINTS:
    TIDY_SQL = f"replace({TIDY_SQL}, '{_a}', '{_b.replace(chr(39), chr(39) * 2)}')"


@query(f"SELECT run_id, page_id, sha256({TIDY_SQL}) AS hash FROM pages GROUP BY ALL")
def tx9_space_and_misprints(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "raw_text")
    return p.select("run_id", "page_id", L.text_hash(C.fix_misprints(C.tidy_space(F.coalesce("raw_text", F.lit(""))))).alias("hash")).distinct()


NORMAL_SQL = f"regexp_replace(coalesce(clean_text, ''), '</?(?:{C.LEAK_TAGS})\\b[^>]*>', '', 'gi')"
NORMAL_SQL = f"regexp_replace({NORMAL_SQL}, '([\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}})-[{SPACE_SQL}]*\\n[{SPACE_SQL}]*([\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}})', '\\1\\2', 'g')"
NORMAL_SQL = f"regexp_replace({NORMAL_SQL}, '([\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}})-[{SPACE_SQL}]{{1,3}}([\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}})', '\\1\\2', 'g')"
NORMAL_SQL = f"trim(regexp_replace({NORMAL_SQL}, '[{SPACE_SQL}]+', ' ', 'g'))"


@query(f"SELECT run_id, page_id, sha256({NORMAL_SQL}) AS hash FROM pages GROUP BY ALL")
def tx10_normalize(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    return p.select("run_id", "page_id", L.text_hash(C.normalize(F.col("clean_text"))).alias("hash")).distinct()


ORACLE_SQL["snk6_bundle_documents"] = f"""
WITH {PAGES_SQL}, done AS (SELECT DISTINCT run_id, document_id FROM run_documents WHERE status = 'completed'), p AS (SELECT * FROM pages_once SEMI JOIN done USING (run_id, document_id)),
 filled AS (SELECT DISTINCT run_id, document_id FROM p WHERE length(coalesce(raw_text, '')) > 0 OR length(coalesce(clean_text, '')) > 0),
 t AS (SELECT run_id, document_id, count(*) AS page_count, string_agg(coalesce(clean_text, ''), {BREAK_SQL} ORDER BY page_num) AS clean_text,
  coalesce(array_to_string(list_sort(list_distinct(flatten(list(coalesce(quality_flags, []))))), '|'), '') AS quality_flags FROM p SEMI JOIN filled USING (run_id, document_id) GROUP BY ALL),
 d AS (SELECT document_id, coalesce(nullif(display_title, ''), nullif(pdf_title, '')) AS title, coalesce(nullif(display_title, ''), nullif(filename, ''), '') AS shown, language FROM documents),
 n AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(shown, '[^\\p{{L}}\\p{{N}}_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'document') || '__' || substr(document_id, 1, 8) || '.txt' AS stem FROM t LEFT JOIN d USING (document_id))
SELECT run_id, document_id, title, array_to_string({LIST_SQL.format('language')}, '|') AS language, page_count, 'raw/' || stem AS raw_file, 'clean/' || stem AS clean_file, 'normalized/' || stem AS normalized_file,
 sha256({NORMAL_SQL}) AS normalized_text_sha256, quality_flags FROM n"""


def _cleaning_sql() -> str:
    """The full and the least cleaning as SQL, but for tables and entities, of which the raw texts hold none; tx5 and tx7 try these."""
    ends = f"'^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g'"
    markers = MARKERS_SQL.replace("coalesce(raw_text, '')", "t")
    boxed, plain = MARKERS_SQL.split("regexp_replace(coalesce(raw_text, ''), ", 1)[1].split(", '', 'gs')", 1)[0], f"'<\\|ref\\|>(.*?)<\\|/ref\\|>[{SPACE_SQL}]*\\[\\[[\\p{{Nd}}{SPACE_SQL},]+\\]\\]', '\\1', 'gs'"
    least = f"regexp_replace(regexp_replace(t, {boxed}, '', 'gs'), {plain})"
    for token in C.MODEL_TOKENS:
        least = f"replace({least}, '{token}', '')"
    tidy = TIDY_SQL.replace("coalesce(raw_text, '')", "t")
    return f"""
WITH a AS (SELECT DISTINCT run_id, page_id, coalesce(nfc_normalize(raw_text), '') AS t FROM pages), b AS (SELECT run_id, page_id, {least} AS l, {markers} AS t FROM a), c AS (SELECT run_id, page_id, l, {TAGS_SQL} AS t FROM b),
 e AS (SELECT run_id, page_id, l, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])- ?\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM c), f AS (SELECT run_id, page_id, l, {tidy} AS t FROM e)
SELECT run_id, page_id, sha256(regexp_replace(t, {ends})) AS clean_hash, sha256(regexp_replace(replace(l, '\\x00', ''), {ends})) AS fidelity_hash FROM f"""


@query(_cleaning_sql())
def tx_clean(spark, d):
    """The full and the least cleaning of every raw page."""
    p = table(spark, d, "pages", "run_id", "page_id", "raw_text")
    return p.select("run_id", "page_id", L.text_hash(C.clean(F.col("raw_text"))).alias("clean_hash"), L.text_hash(C.clean_fidelity(F.col("raw_text"), True)).alias("fidelity_hash")).distinct()


@query(r"""
SELECT document_id, coalesce(nullif(regexp_replace(regexp_replace(filename, '[^\p{L}\p{N}_.-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'document') || '__' || substr(document_id, 1, 8) AS stem,
 coalesce(nullif(regexp_replace(regexp_replace(filename, '(.)\.[^.]*$', '\1'), '[^\p{L}\p{N}_.-]', '_', 'g'), ''), 'document') AS artifact FROM documents""")
def tx11_stems(spark, d):
    return table(spark, d, "documents", "document_id", "filename").select("document_id", L.file_stem(F.col("filename"), F.col("document_id")).alias("stem"), L.artifact_stem(F.col("filename")).alias("artifact"))


@query("SELECT document_id, coalesce(array_to_string(from_json(tags_json, '[\"VARCHAR\"]'), '|'), '') AS tags FROM documents")
def tx12_json_lists(spark, d):
    return table(spark, d, "documents", "document_id", "tags_json").select("document_id", F.array_join(L.json_list(F.col("tags_json")), "|").alias("tags"))


@query(f"SELECT document_id, array_to_string({LIST_SQL.format('language')}, '|') AS languages FROM documents")
def tx13_language_lists(spark, d):
    return table(spark, d, "documents", "document_id", "language").select("document_id", F.array_join(L.language_list(F.col("language")), "|").alias("languages"))


@query("SELECT document_id, sha256(coalesce(text, '')) AS hash FROM documents")
def tx14_text_hash(spark, d):
    return table(spark, d, "documents", "document_id", "text").select("document_id", L.text_hash(F.col("text")).alias("hash"))


@query(f"SELECT document_id, {HASH_SQL.format('file_sha256')} AS bucket, {SPLIT_SQL.format(HASH_SQL.format('file_sha256'))} AS split FROM documents")
def tx15_hash_split(spark, d):
    return table(spark, d, "documents", "document_id", "file_sha256").select("document_id", L.hash_bucket(F.col("file_sha256")).alias("bucket"), L.hash_split(F.col("file_sha256")).alias("split"))


@query("SELECT id, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' WHEN n < 1000000 THEN '100K<n<1M' ELSE '1M<n<10M' END AS bucket FROM (SELECT id, id * 37 AS n FROM run_events GROUP BY id)")
def tx16_size_bucket(spark, d):
    return table(spark, d, "run_events", "id").distinct().select("id", L.size_bucket(F.col("id") * 37).alias("bucket"))


def tx18_direction_wrap(spark, d):
    """Every page with its right-to-left text marked; of pages of mixed direction block by block."""
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text", "script_direction")
    return p.select("run_id", "page_id", L.text_hash(X.direction_wrap(F.col("clean_text"), F.col("script_direction"))).alias("hash")).distinct()


QUERIES["tx18_direction_wrap"] = tx18_direction_wrap


def tx18_mixed_blocks(spark, d):
    """Every document as if its direction were mixed: each block judged by its own characters."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", L.text_hash(X.direction_wrap(F.col("text"), F.lit("mixed"))).alias("hash")).distinct()


QUERIES["tx18_mixed_blocks"] = tx18_mixed_blocks


# ---------------------------------------------------------------- quality

STRIP_SQL = f"regexp_replace(coalesce(clean_text, ''), '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')"
HY_SQL = f"(len(regexp_extract_all(t, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}-[{SPACE_SQL}]*\\n[{SPACE_SQL}]*[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}')) + len(regexp_extract_all(t, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}-[{SPACE_SQL}]{{1,3}}[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{2,}}')))"
VALID_SQL = f"""
WITH p AS (SELECT DISTINCT run_id, page_id, {STRIP_SQL} AS t FROM pages), q AS (SELECT *, {lines_sql('t')} AS x, replace(replace(t, ' ', ''), chr(10), '') AS s FROM p),
 c AS (SELECT run_id, page_id, arg_max(ch, (n, -f)) AS ch, max(n) AS top FROM (SELECT run_id, page_id, h[i] AS ch, count(*) AS n, min(i) AS f FROM (SELECT run_id, page_id, string_split(s, '') AS h FROM q WHERE s <> ''), unnest(range(1, len(h) + 1)) AS u(i) GROUP BY ALL) GROUP BY ALL)
SELECT run_id, page_id, length(t)::BIGINT AS text_length, len(x)::BIGINT AS total_lines, len(list_distinct(x))::BIGINT AS unique_lines, ch AS dominant_char, coalesce(top, 0)::BIGINT AS dominant_char_count,
 {HY_SQL}::BIGINT AS line_hyphenation_count, regexp_matches(t, '(?i)</?(?:{C.LEAK_TAGS})\\b[^>]*>') AS markup
FROM q LEFT JOIN c USING (run_id, page_id) WHERE length(t) >= 20"""


@query(VALID_SQL)
def vl_metrics(spark, d):
    """Metrics of every page that is not empty."""
    q = with_quality(table(spark, d, "pages", "run_id", "page_id", "page_num", "clean_text"), "clean_text", "page_num").filter("quality.status <> 'empty'")
    return q.select("run_id", "page_id", *[f"quality.{c}" for c in ("text_length", "total_lines", "unique_lines", "dominant_char", "dominant_char_count", "line_hyphenation_count")], F.array_contains("quality.flags", "markup_leak").alias("markup")).distinct()


@query(f"""
WITH p AS (SELECT DISTINCT run_id, page_id, {STRIP_SQL} AS t FROM pages), q AS (SELECT *, {lines_sql('t')} AS x FROM p)
SELECT run_id, page_id, CASE WHEN length(t) < 20 THEN 'empty' WHEN len(x) > 0 AND 1 - len(list_distinct(x)) / len(x) > 0.60 THEN 'extreme' WHEN len(x) > 0 AND 1 - len(list_distinct(x)) / len(x) > 0.35 THEN 'moderate' ELSE 'ok' END AS repetition FROM q""")
def vl2_repetition(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "page_num", "clean_text")
    r = F.col("quality.repetition_ratio")
    label = F.when(F.col("quality.status") == "empty", "empty").when(r > 0.60, "extreme").when(r > 0.35, "moderate").otherwise("ok")
    return with_quality(p, "clean_text", "page_num").select("run_id", "page_id", label.alias("repetition")).distinct()


@query("SELECT DISTINCT run_id, page_id, regexp_matches(coalesce(raw_text, ''), '(<\\|det\\|>){3,}|(<\\|grounding\\|>){2,}') AS artifact FROM (SELECT run_id, page_id, CASE WHEN page_num % 5 = 0 THEN repeat('<|det|>', page_num % 6) || raw_text WHEN page_num % 5 = 1 THEN repeat('<|grounding|>', page_num % 4) || raw_text ELSE raw_text END AS raw_text FROM pages)")
def vl5_marker_artifacts(spark, d):
    """Repeated markers of the model, some put before the raw texts."""
    p = table(spark, d, "pages", "run_id", "page_id", "page_num", "raw_text")
    n = F.col("page_num")
    made = F.when(n % 5 == 0, F.concat(F.expr("repeat('<|det|>', page_num % 6)"), "raw_text")).when(n % 5 == 1, F.concat(F.expr("repeat('<|grounding|>', page_num % 4)"), "raw_text")).otherwise(F.col("raw_text"))
    return p.select("run_id", "page_id", marker_artifacts(F.coalesce(made, F.lit(""))).alias("artifact")).distinct()


def _quality_sql(source: str) -> str:
    """CTEs that end in ``judged``: the rows of ``source(id, page_num, raw)`` with t, status, issues, flags as SQL tells them.

    A unit that stands eleven times in a row is told without back-references: inside a word by comparing it with itself some places on, and with
    the blanks behind it by comparing neighbouring words, where the first need only end with the unit and the last only begin with it.
    """
    space, percent = SPACE_SQL, "round_even({0} * 100, 0)::BIGINT || '%'"
    short, extreme, moderate = "length(t) < 20", "n > 0 AND ratio > 0.60", "n > 0 AND ratio > 0.35"
    issues = [
        f"CASE WHEN {extreme} THEN 'extreme repetition (' || {percent.format('ratio')} || ' duplicate lines)' WHEN {moderate} THEN 'moderate repetition (' || {percent.format('ratio')} || ' duplicate lines)' END",
        "CASE WHEN run >= 5 THEN run || ' consecutive identical lines' END", f"CASE WHEN share > 0.5 THEN chr(39) || ch || chr(39) || ' is ' || {percent.format('share')} || ' of output' END", "CASE WHEN artifact THEN 'model artifact detected' END",
        "CASE WHEN hyphens > 0 THEN 'line-break hyphenation remains (' || hyphens || ' segment(s))' END", "CASE WHEN markup THEN 'markup tag leaked into clean text' END",
    ]
    return rf"""
 src AS ({source}), p AS (SELECT *, regexp_replace(coalesce(raw, ''), '^[{space}]+|[{space}]+$', '', 'g') AS t FROM src),
 q AS (SELECT *, {lines_sql('t')} AS x, replace(replace(t, ' ', ''), chr(10), '') AS s, regexp_extract_all(t, '[^{space}]+[{space}]+') AS e FROM p),
 counted AS (SELECT id, arg_max(ch, (k, -f)) AS ch, max(k) AS top FROM (SELECT id, c[i] AS ch, count(*) AS k, min(i) AS f FROM (SELECT id, string_split(s, '') AS c FROM q WHERE s <> ''), unnest(range(1, len(c) + 1)) AS u(i) GROUP BY ALL) GROUP BY id),
 rows_ AS (SELECT id, max(k) AS run FROM (SELECT id, line, island, count(*) AS k FROM (SELECT id, line, i - row_number() OVER (PARTITION BY id, line ORDER BY i) AS island FROM (SELECT id, i, x[i] AS line FROM q, unnest(range(1, len(x) + 1)) AS u(i))) GROUP BY ALL) GROUP BY id),
 long_ AS (SELECT id, unnest(regexp_extract_all(t, '[^{space}]{{11,}}')) AS w FROM p),
 inside AS (SELECT w FROM (SELECT DISTINCT w FROM long_) WHERE len(list_filter(range(1, length(w) // 11 + 1), lambda k: contains(array_to_string(list_transform(range(1, length(w) - k + 1), lambda j: CASE WHEN substr(w, j, 1) = substr(w, j + k, 1) THEN '1' ELSE '0' END), ''), repeat('1', 10 * k)))) > 0),
 units AS (SELECT DISTINCT id FROM long_ SEMI JOIN inside USING (w)),
 el AS (SELECT id, i, e[i] AS w FROM q, unnest(range(1, len(e) + 1)) AS u(i)),
 same AS (SELECT id, w, island, count(*) AS k, min(i) AS lo, max(i) AS hi FROM (SELECT id, i, w, i - row_number() OVER (PARTITION BY id, w ORDER BY i) AS island FROM el) GROUP BY ALL HAVING count(*) >= 9),
 across AS (SELECT DISTINCT r.id FROM same r LEFT JOIN el a ON a.id = r.id AND a.i = r.lo - 1 LEFT JOIN el b ON b.id = r.id AND b.i = r.hi + 1 WHERE k + coalesce(ends_with(a.w, r.w), false)::INT + coalesce(starts_with(b.w, r.w), false)::INT >= 11),
 facts AS (SELECT q.*, len(x) AS n, CASE WHEN len(x) > 0 THEN 1 - len(list_distinct(x)) / len(x) END AS ratio, coalesce(run, 0)::BIGINT AS run, ch, coalesce(top / nullif(length(s), 0), 0) AS share, {HY_SQL} AS hyphens, regexp_matches(t, '(?i)</?(?:{C.LEAK_TAGS})\b[^>]*>') AS markup,
  regexp_matches(t, '(<\|det\|>){{3,}}|(<\|grounding\|>){{2,}}') OR units.id IS NOT NULL OR across.id IS NOT NULL AS artifact
  FROM q LEFT JOIN counted USING (id) LEFT JOIN rows_ USING (id) LEFT JOIN units USING (id) LEFT JOIN across USING (id)),
 told AS (SELECT *, CASE WHEN {short} THEN ['output too short (' || length(t) || ' chars)'] ELSE list_filter([{', '.join(issues)}], lambda z: z IS NOT NULL) END AS found FROM facts),
 judged AS (SELECT *, CASE WHEN {short} THEN 'empty' WHEN coalesce({extreme}, false) OR artifact OR share > 0.5 THEN 'fail' WHEN len(found) > 0 THEN 'warn' ELSE 'pass' END AS status, list_transform(found, lambda z: 'Page ' || page_num || ': ' || z) AS issues,
  CASE WHEN {short} THEN [] ELSE list_filter([CASE WHEN hyphens > 0 THEN 'line_hyphenation' END, CASE WHEN markup THEN 'markup_leak' END], lambda z: z IS NOT NULL) END AS flags FROM told)"""


VALIDATE_SQL = f"""
WITH once AS (SELECT DISTINCT run_id, page_id, page_num, clean_text FROM pages), {_quality_sql("SELECT row_number() OVER () AS id, run_id, page_id, page_num, clean_text AS raw FROM once")}
SELECT run_id, page_id, status, coalesce(array_to_string(issues, ' / '), '') AS issues, coalesce(array_to_string(flags, '|'), '') AS flags FROM judged"""


@query(VALIDATE_SQL)
def vl_validate(spark, d):
    """Status, issues and flags of every page, all rules."""
    p = table(spark, d, "pages", "run_id", "page_id", "page_num", "clean_text")
    return with_quality(p, "clean_text", "page_num").select("run_id", "page_id", "quality.status", F.array_join("quality.issues", " / ").alias("issues"), F.array_join("quality.flags", "|").alias("flags")).distinct()


@query(f"""
WITH once AS (SELECT DISTINCT document_id, page_id, page_num, raw_text FROM pages), {_quality_sql("SELECT row_number() OVER () AS id, document_id, page_id, page_num, raw_text AS raw FROM once")}
SELECT coalesce(lang, 'none') AS lang, status, count(*) AS pages FROM judged JOIN (SELECT document_id, lang FROM documents) USING (document_id) GROUP BY ALL""")
def vl_status_by_language(spark, d):
    """Pages of each status by catalog language, judged from the raw text; the flagship."""
    p = table(spark, d, "pages", "document_id", "page_id", "page_num", "raw_text")
    # a page is judged where it lies; what moves tells repeated rows by a digest of their text
    judged = with_quality(p, "raw_text", "page_num").select("document_id", "page_id", F.xxhash64("raw_text", "page_num").alias("digest"), F.col("quality.status").alias("status")).distinct()
    docs = table(spark, d, "documents", "document_id", "lang")
    return judged.join(docs, "document_id").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "status").agg(F.count(F.lit(1)).alias("pages"))


@query(f"""
WITH once AS (SELECT DISTINCT doc_id, text FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN repeat(substr(text, 1, 40) || chr(10), 8) || text WHEN 1 THEN text || repeat(' ab', 12) || ' end' WHEN 2 THEN text || repeat('xyz', 11) WHEN 3 THEN regexp_replace(text, '[a-z]', 'a', 'g') WHEN 4 THEN text || ' <TD class=x> müba-' || chr(10) || 'delesi' ELSE repeat('satir bir' || chr(10), 2) || text END AS text FROM documents)), {_quality_sql("SELECT row_number() OVER () AS id, doc_id, doc_id AS page_num, text AS raw FROM once")}
SELECT doc_id, status, coalesce(array_to_string(issues, ' / '), '') AS issues, coalesce(array_to_string(flags, '|'), '') AS flags FROM judged""")
def vl_rules_on_spoiled_texts(spark, d):
    """The rules over texts spoiled in the ways they tell: lines and units again and again, one character most of the text, markup and divided words."""
    made = F.expr(
        "CASE doc_id % 6 WHEN 0 THEN concat(repeat(concat(substr(text, 1, 40), '\n'), 8), text) WHEN 1 THEN concat(text, repeat(' ab', 12), ' end') WHEN 2 THEN concat(text, repeat('xyz', 11)) WHEN 3 THEN regexp_replace(text, '[a-z]', 'a')"
        " WHEN 4 THEN concat(text, ' <TD class=x> müba-\ndelesi') ELSE concat(repeat('satir bir\n', 2), text) END"
    )
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.col("doc_id").alias("n"), made.alias("text"))
    return with_quality(docs, "text", "n").select("doc_id", "quality.status", F.array_join("quality.issues", " / ").alias("issues"), F.array_join("quality.flags", "|").alias("flags")).distinct()


# ---------------------------------------------------------------- script


@query()
def sc_analysis(spark, d):
    """Direction, script, counts and hints of every page."""
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    a = p.withColumn("n", S.script_counts("clean_text")).withColumn("a", S.analysis(F.col("clean_text"), F.col("n")))
    return a.select("run_id", "page_id", "a.direction", "a.primary_script", "a.arabic_char_count", "a.latin_char_count", "a.extended_latin_count", "a.has_diacritics", F.array_join("a.detected_languages", "|").alias("languages")).distinct()


@query(f"""
SELECT run_id, page_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '[{S.TURKISH}]') THEN 'tr' END, CASE WHEN regexp_matches(t, '[{S.OTTOMAN_LATIN}]') THEN 'ota-latn' END], lambda x: x IS NOT NULL), '|') AS hints
FROM (SELECT DISTINCT run_id, page_id, coalesce(clean_text, '') AS t FROM pages)""")
def sc6_letter_hints(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    return p.select("run_id", "page_id", F.array_join(S.language_hints(F.coalesce("clean_text", F.lit("")), F.lit(0)), "|").alias("hints")).distinct()


@query(f"""
WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')), lambda x: x <> '') AS x FROM documents)
SELECT doc_id, i::BIGINT AS block, substr(x[i + 1], 1, 100) AS preview FROM b, unnest(range(len(x))) AS t(i)""")
def sc8_blocks(spark, d):
    b = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(S.blocks(F.col("text"))).alias("block", "text"))
    return b.select("doc_id", F.col("block").cast("bigint").alias("block"), F.substring("text", 1, 100).alias("preview"))


@query()
def sc8_block_scripts(spark, d):
    """Direction and script of every block of every document."""
    b = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(S.blocks(F.col("text"))).alias("block", "text"))
    a = b.withColumn("n", S.script_counts("text")).withColumn("a", S.analysis(F.col("text"), F.col("n")))
    return a.select("doc_id", F.col("block").cast("bigint").alias("block"), "a.direction", "a.primary_script")


# ---------------------------------------------------------------- metadata and events


@query(f"""
SELECT run_id, page_id, length(t)::BIGINT AS chars, w AS words, len({lines_sql('t')})::BIGINT AS lines, floor(w * 1.3::DOUBLE)::BIGINT AS tokens_approx
FROM (SELECT *, len(regexp_extract_all(t, '[^{SPACE_SQL}]+'))::BIGINT AS w FROM (SELECT DISTINCT run_id, page_id, coalesce(clean_text, '') AS t FROM pages))""")
def md1_lengths(spark, d):
    p = table(spark, d, "pages", "run_id", "page_id", "clean_text")
    return p.select("run_id", "page_id", P.measures(F.col("clean_text")).alias("m")).select("run_id", "page_id", "m.*").distinct()


MD1_SQL = ORACLE_SQL["md1_lengths"]


def md3_page_metadata(spark, d):
    """The metadata record of every page: lengths, script and quality together."""
    made = P.page_metadata(table(spark, d, "pages", "run_id", "page_id", "page_num", "clean_text"))
    return made.select("run_id", "page_id", "chars", "words", "lines", "tokens_approx", "direction", "primary_script", "arabic_char_count", "latin_char_count", "has_diacritics", F.array_join("detected_languages", "|").alias("languages"), "status", F.array_join("flags", "|").alias("flags")).distinct()


QUERIES["md3_page_metadata"] = md3_page_metadata

EVENTS_SQL = "e AS (SELECT * FROM run_events QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id) = 1)"


@query(f"""
WITH {EVENTS_SQL}, x AS (SELECT max(run_id) AS r FROM e) SELECT id, event_type, payload FROM e WHERE run_id = (SELECT r FROM x) ORDER BY id LIMIT 1000""")
def ev2_replay(spark, d):
    events = table(spark, d, "run_events")
    run = events.agg(F.max("run_id")).first()[0]
    return E.replay(events, run).select("id", "event_type", "payload")


@query(f"""
WITH {EVENTS_SQL}, s AS (SELECT run_id, greatest(count(*) FILTER (event_type = 'page_complete'), coalesce(sum((payload ->> '$.pages')::BIGINT) FILTER (event_type = 'document_complete'), 0))::BIGINT AS pages_done, count(*) FILTER (event_type = 'document_complete') AS documents_done, count(*) FILTER (event_type = 'page_retry') AS retries,
 count(*) FILTER (event_type = 'run_complete') > 0 AS completed, count(*) FILTER (event_type = 'run_failed') > 0 AS failed, max(id) AS last_event_id FROM e GROUP BY run_id)
SELECT s.*, CASE WHEN completed THEN 1.0 WHEN coalesce(pages_total, 0) <= 0 THEN 0.0 ELSE least(0.99, pages_done::DOUBLE / pages_total) END::DOUBLE AS progress FROM s LEFT JOIN runs ON runs.id = s.run_id""")
def ev3_progress(spark, d):
    """Pages done of every run and their share."""
    state = E.run_state(E.once(table(spark, d, "run_events")))
    return E.with_progress(state, table(spark, d, "runs", "id", "pages_total")).select("run_id", "pages_done", "documents_done", "retries", "completed", "failed", "last_event_id", "progress")


@query(f"""
WITH {EVENTS_SQL}, s AS (SELECT run_id, arg_max(event_type, id) AS last_event, count(*) AS events, bool_or(event_type = 'run_started') AS began, bool_or(event_type = 'dataset_export_started') AS exporting, bool_or(event_type = 'run_complete') AS completed, bool_or(event_type = 'run_failed') AS failed FROM e GROUP BY run_id)
SELECT run_id, last_event, events, CASE WHEN failed THEN 'failed' WHEN completed THEN 'completed' WHEN began THEN 'processing' ELSE 'queued' END AS status, CASE WHEN failed THEN 'failed' WHEN completed THEN 'completed' WHEN began THEN CASE WHEN exporting THEN 'exporting' ELSE 'ocr' END ELSE 'queued' END AS stage FROM s""")
def ev5_lifecycle(spark, d):
    return E.lifecycle(E.once(table(spark, d, "run_events", "id", "run_id", "event_type")))


@query(f"""
WITH {EVENTS_SQL} SELECT run_id, payload ->> '$.document_id' AS document_id, count(*) AS retries, max((payload ->> '$.attempt')::BIGINT) AS last_attempt FROM e WHERE event_type = 'page_retry' GROUP BY ALL""")
def ev6_retries(spark, d):
    e = E.once(table(spark, d, "run_events", "id", "run_id", "event_type", "payload")).filter("event_type = 'page_retry'")
    doc, attempt = F.get_json_object("payload", "$.document_id"), F.get_json_object("payload", "$.attempt").cast("bigint")
    return e.groupBy("run_id", doc.alias("document_id")).agg(F.count(F.lit(1)).alias("retries"), F.max(attempt).alias("last_attempt"))


# ---------------------------------------------------------------- SQL that takes the Unicode tables to write


@lru_cache(1)
def _script_classes() -> list[str]:
    """For each trait of a character, all code points that have it, as the inside of a character class."""
    spans: list[list[list[int]]] = [[] for _ in range(5)]
    for cp in range(0x110000):
        if 0xD800 <= cp < 0xE000:
            continue
        for found, hit in zip(spans, S.traits.__wrapped__(chr(cp))):
            if hit:
                if found and found[-1][1] == cp - 1:
                    found[-1][1] = cp
                else:
                    found.append([cp, cp])
    return ["".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in found) for found in spans]


def _script_sql(source: str, keys: str, columns: str) -> str:
    n = ", ".join(f"len(regexp_extract_all(t, '[{c}]'))::BIGINT AS {name}" for name, c in zip(("ltr", "rtl", "arabic", "latin", "extended"), _script_classes()))
    return f"""
WITH p AS ({source}), n AS (SELECT *, {n} FROM p),
 d AS (SELECT *, CASE WHEN ltr + rtl = 0 THEN 'undetermined' WHEN rtl / (ltr + rtl) > 0.8 THEN 'rtl' WHEN ltr / (ltr + rtl) > 0.8 THEN 'ltr' WHEN rtl / (ltr + rtl) > 0.15 AND ltr / (ltr + rtl) > 0.15 THEN 'mixed' WHEN rtl > ltr THEN 'rtl' ELSE 'ltr' END AS direction,
  regexp_matches(t, '[{S.OTTOMAN_LATIN}]') AS ottoman, regexp_matches(t, '[{S.TURKISH}]') AS turkish FROM n),
 s AS (SELECT *, CASE WHEN arabic > latin AND arabic > 20 THEN 'arabic' WHEN ottoman AND extended > 5 THEN 'latin_extended' WHEN direction = 'mixed' THEN 'mixed' WHEN latin > 0 THEN 'latin' ELSE 'undetermined' END AS primary_script,
  array_to_string(list_filter([CASE WHEN turkish THEN 'tr' END, CASE WHEN arabic > 50 THEN 'ar' END, CASE WHEN turkish AND arabic > 50 THEN 'ota' END, CASE WHEN ottoman THEN 'ota-latn' END], lambda x: x IS NOT NULL), '|') AS languages FROM d)
SELECT {keys}, direction, primary_script{columns} FROM s"""


def oracle_sql() -> dict[str, str]:
    """All SQL, with that which is generated."""
    blocks = f"SELECT doc_id, i::BIGINT AS block, x[i + 1] AS t FROM (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda x: regexp_replace(x, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')), lambda x: x <> '') AS x FROM documents), unnest(range(len(x))) AS u(i)"
    counted = ", arabic AS arabic_char_count, latin AS latin_char_count, extended AS extended_latin_count, extended > 5 AS has_diacritics, languages"
    analysed = _script_sql("SELECT DISTINCT run_id, page_id, coalesce(clean_text, '') AS t FROM pages", "run_id, page_id", counted)
    ltr, rtl = _script_classes()[:2]
    parts = f"list_transform(string_split(b, {NL_SQL} || {NL_SQL}), lambda x: struct_pack(x := x, l := len(regexp_extract_all(x, '[{ltr}]')), r := len(regexp_extract_all(x, '[{rtl}]'))))"
    right = "(p.l + p.r > 0 AND (p.r / (p.l + p.r) > 0.8 OR (p.r > p.l AND NOT (p.r / (p.l + p.r) > 0.15 AND p.l / (p.l + p.r) > 0.15))))"
    mixed = f"array_to_string(list_transform({parts}, lambda p: CASE WHEN {right} THEN '<div dir=\"rtl\">' || {NL_SQL} || p.x || {NL_SQL} || '</div>' ELSE p.x END), {NL_SQL} || {NL_SQL})"
    whole = f"'<div dir=\"rtl\">' || {NL_SQL} || {NL_SQL} || b || {NL_SQL} || {NL_SQL} || '</div>'"
    return ORACLE_SQL | {
        "sc_analysis": analysed,
        "sc8_block_scripts": _script_sql(blocks, "doc_id, block", ""),
        "snk2_markdown": ORACLE_SQL["snk2_markdown"].replace("__MIXED__", mixed.replace("string_split(b,", "string_split(body,")),
        "tx18_direction_wrap": f"SELECT DISTINCT run_id, page_id, sha256(CASE script_direction WHEN 'rtl' THEN {whole} WHEN 'mixed' THEN {mixed} ELSE b END) AS hash FROM (SELECT DISTINCT run_id, page_id, script_direction, coalesce(clean_text, '') AS b FROM pages)",
        "tx18_mixed_blocks": f"SELECT DISTINCT doc_id, sha256({mixed}) AS hash FROM (SELECT doc_id, coalesce(text, '') AS b FROM documents)",
        "md3_page_metadata": f"""
SELECT DISTINCT run_id, page_id, m.chars, m.words, m.lines, m.tokens_approx, direction, primary_script, arabic_char_count, latin_char_count, has_diacritics, languages, status, flags
FROM ({MD1_SQL}) m JOIN ({analysed}) s USING (run_id, page_id) JOIN ({VALIDATE_SQL}) v USING (run_id, page_id)""",
    }
