"""Dataset exports: Parquet pages and documents, a text bundle, image and text pairs, each with a manifest.

Rows are plans over the tables of runs, documents and pages; writers put them below a temporary name and swap it in.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.clean import normalize
from pagewright.functions.labels import file_stem, first_filled, hash_split, language_list, text_hash
from pagewright.functions.script import wrap_blocks
from pagewright.operators.catalog import language_or
from pagewright.operators.pages import PAGE_BREAK, join_pages
from pagewright.operators.rollup import STATUSES, distinct_items

# Catalog columns of an export; the names of all output columns and manifest keys below are fixed by the formats too.
CATALOG = ("group_path", "author", "work", "book", "document_date_label", "document_date_precision", "script", "license", "source_citation", "notes")
PAGE_KEYS = ["run_id", "document_id", "page_num"]
TEXT_MODES = {"clean": "cleaned_machine_ocr", "raw": "machine_ocr"}


def _catalog(documents: DataFrame) -> DataFrame:
    """The catalog columns an export shows, under names that meet none of the page tables."""
    return documents.select(
        "document_id", "filename", "file_sha256", "pdf_title", "pdf_author", F.col("display_title").alias("cat_title"), F.col("language").alias("cat_language"),
        *[F.col(c).alias(f"cat_{c}") for c in CATALOG],
    ).dropDuplicates(["document_id"])


def unique_pages(pages: DataFrame) -> DataFrame:
    """One row per run, document and page number; repeated rows are equal, so any stands."""
    return pages.dropDuplicates(PAGE_KEYS)


def dataset_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The page rows of the Parquet dataset; catalog values come first, then what the PDF or the page tells."""
    p = unique_pages(pages).join(_catalog(documents), "document_id")
    return p.select(
        F.concat(F.lit("run-"), "run_id").alias("dataset_export_id"), "run_id", "page_id", "document_id", F.col("filename").alias("document_name"),
        first_filled(F.col("cat_title"), F.col("pdf_title")).alias("title"), F.col("cat_group_path").alias("group_path"),
        first_filled(F.col("cat_author"), F.col("pdf_author")).alias("author"), F.col("cat_work").alias("work"), F.col("cat_book").alias("book"),
        F.col("cat_document_date_label").alias("document_date_label"), F.col("cat_document_date_precision").alias("document_date_precision"),
        language_or(language_list(F.col("cat_language")), F.col("detected_languages")).alias("language"),
        first_filled(F.col("cat_script"), F.col("primary_script")).alias("script"), F.col("cat_license").alias("license"), F.col("cat_source_citation").alias("source_citation"),
        F.col("page_num").alias("page_number"), F.col("file_sha256").alias("source_pdf_sha256"), "raw_text", "clean_text",
        text_hash(F.col("raw_text")).alias("raw_text_sha256"), text_hash(F.col("clean_text")).alias("clean_text_sha256"),
        F.col("status").alias("validation_status"), "validation_issues", "script_direction", "primary_script", "detected_languages", "token_count_cl100k",
        "text_length_chars", "text_length_words", "dpi_used", "has_embedded_text", "is_image_only", "pipeline_version", "model_used",
        hash_split(F.col("file_sha256")).alias("split"),
    )


def _gathered(pages: DataFrame, *columns: str) -> DataFrame:
    """``run_id, document_id, p``: the distinct pages of each document of a run in order, as one array of structs of the columns.

    Repeated page rows are equal and meet here anyway, so the text of a page moves once.
    """
    each = F.array_sort(F.collect_list(F.struct("page_num", *columns)))
    once = F.filter("__p", lambda x, i: (i == 0) | ~x["page_num"].eqNullSafe(F.element_at("__p", F.greatest(i, F.lit(1)))["page_num"]))
    return pages.groupBy("run_id", "document_id").agg(each.alias("__p")).select("run_id", "document_id", once.alias("p"))


def _all(name: str) -> Column:
    """One field of the gathered pages as an array."""
    return F.transform("p", lambda x: x[name])


def _joined(name: str) -> Column:
    return F.array_join(F.transform("p", lambda x: F.coalesce(x[name], F.lit(""))), PAGE_BREAK)


def _most(name: str, default: str) -> Column:
    """The most frequent value of a field, of equals the one seen first; ``default`` where all are null."""
    values = F.filter(_all(name), lambda x: x.isNotNull())
    counted = F.transform(F.array_distinct(values), lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("at"), v.alias("v")))
    return F.coalesce(F.array_max(counted)["v"], F.lit(default))


def _with_status(status: str) -> Column:
    return F.size(F.filter("p", lambda x: x["status"] == status)).cast("bigint")


def _items(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: F.coalesce(x[name], F.array().cast("array<string>"))))))


def dataset_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """The document rows of the Parquet dataset, rolled up from the pages of each run in one aggregation."""
    shown = pages.withColumn("wrapped", _mixed_blocks(F.col("clean_text"), F.col("script_direction")))
    p = _gathered(
        shown, "raw_text", "clean_text", "wrapped", "status", "script_direction", "primary_script", "detected_languages", "token_count_cl100k", "pipeline_version", "model_used",
    )
    total = F.aggregate("p", F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(x["token_count_cl100k"], F.lit(0)))
    rolled = p.select(
        "run_id", "document_id", "p", F.size("p").cast("bigint").alias("pages"), total.alias("total_tokens"),
        *[_with_status(s).alias(f"pages_{s}") for s in STATUSES],
        _most("script_direction", "ltr").alias("dominant_direction"), _most("primary_script", "unknown").alias("dominant_script"), _items("detected_languages").alias("languages_detected"),
        _joined("raw_text").alias("raw_text"), _joined("clean_text").alias("clean_text"), F.array_min(_all("pipeline_version")).alias("pipeline_version"), F.array_min(_all("model_used")).alias("model_used"),
    )
    joined = rolled.join(_catalog(documents), "document_id").withColumn("markdown", _markdown())
    return joined.select(
        F.concat(F.lit("run-"), "run_id").alias("dataset_export_id"), "run_id", "document_id", F.col("filename").alias("document_name"),
        first_filled(F.col("cat_title"), F.col("pdf_title")).alias("title"), F.col("cat_group_path").alias("group_path"),
        first_filled(F.col("cat_author"), F.col("pdf_author")).alias("author"), F.col("cat_work").alias("work"), F.col("cat_book").alias("book"),
        F.col("cat_document_date_label").alias("document_date_label"), F.col("cat_document_date_precision").alias("document_date_precision"),
        language_or(language_list(F.col("cat_language")), F.col("languages_detected")).alias("language"),
        first_filled(F.col("cat_script"), F.col("dominant_script")).alias("script"), F.col("cat_license").alias("license"), F.col("cat_source_citation").alias("source_citation"), F.col("cat_notes").alias("notes"),
        F.col("file_sha256").alias("source_pdf_sha256"), F.col("pages").alias("page_count"), "raw_text", "clean_text",
        text_hash(F.col("raw_text")).alias("raw_text_sha256"), text_hash(F.col("clean_text")).alias("clean_text_sha256"), "markdown",
        "pages_pass", "pages_warn", "pages_fail", "pages_empty", "dominant_script", "dominant_direction", "languages_detected",
        F.col("total_tokens").alias("total_tokens_cl100k"), "pipeline_version", "model_used", hash_split(F.col("file_sha256")).alias("split"),
    )


def completed_pages(pages: DataFrame, run_documents: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Pages of completed documents, of the selected ones where a selection ``(document_id)`` is given.

    Documents whose pages hold no text at all are left out.
    """
    done = run_documents.filter("status = 'completed'").select("run_id", "document_id").distinct()
    p = unique_pages(pages).join(done, ["run_id", "document_id"], "left_semi")
    if selected is not None:
        p = p.join(selected.select("document_id"), "document_id", "left_semi")
    some = p.filter((F.coalesce(F.length("raw_text"), F.lit(0)) > 0) | (F.coalesce(F.length("clean_text"), F.lit(0)) > 0)).select("run_id", "document_id").distinct()
    return p.join(some, ["run_id", "document_id"], "left_semi")


def missing_selection(selected: DataFrame, run_documents: DataFrame) -> str | None:
    """The least selected id that the run does not hold; None if all are there."""
    return selected.join(run_documents.select("document_id"), "document_id", "left_anti").agg(F.min("document_id")).first()[0]


def bundle_pages(pages: DataFrame, run_documents: DataFrame, documents: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The page rows of the text bundle, with the normalized layer."""
    p = completed_pages(pages, run_documents, selected).join(_catalog(documents), "document_id", "left")
    text = normalize(F.col("clean_text"))
    return p.withColumn("normalized", text).select(
        F.col("page_id").alias("id"), "run_id", "document_id", F.col("filename").alias("document_name"), F.col("cat_group_path").alias("group_path"),
        first_filled(F.col("cat_title"), F.col("pdf_title")).alias("title"), first_filled(F.col("cat_author"), F.col("pdf_author")).alias("author"),
        F.col("cat_work").alias("work"), F.col("cat_book").alias("book"), F.col("cat_document_date_label").alias("document_date_label"), F.col("cat_document_date_precision").alias("document_date_precision"),
        language_or(language_list(F.col("cat_language")), F.col("detected_languages")).alias("language"), first_filled(F.col("cat_script"), F.col("primary_script")).alias("script"),
        F.col("page_num").alias("page"), "raw_text", "clean_text", F.col("normalized").alias("normalized_text"),
        text_hash(F.col("raw_text")).alias("raw_text_sha256"), text_hash(F.col("clean_text")).alias("clean_text_sha256"), text_hash(F.col("normalized")).alias("normalized_text_sha256"),
        F.col("status").alias("ocr_status"), "quality_flags", "validation_issues", "extraction_mode", "extraction_attempt",
        F.col("filename").alias("source_file"), F.col("file_sha256").alias("source_pdf_sha256"), F.col("model_used").alias("ocr_model"), "pipeline_version",
    )


def bundle_documents(pages: DataFrame, run_documents: DataFrame, documents: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """The document rows of the text bundle; languages come from the catalog alone."""
    p = completed_pages(pages, run_documents, selected)
    keys = ["run_id", "document_id"]
    raw, text = join_pages(p, keys, "raw_text", out="raw_text"), join_pages(p, keys, "clean_text", out="clean_text")
    about = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("page_count"), distinct_items(F.col("quality_flags")).alias("quality_flags"), F.min("pipeline_version").alias("pipeline_version"), F.min("model_used").alias("ocr_model"))
    joined = raw.join(text, keys).join(about, keys).join(_catalog(documents), "document_id", "left")
    joined = joined.withColumn("stem", file_stem(first_filled(F.col("cat_title"), F.col("filename"), F.lit("")), F.col("document_id"))).withColumn("normalized", normalize(F.col("clean_text")))
    return joined.select(
        "run_id", "document_id", F.col("filename").alias("document_name"), F.col("cat_group_path").alias("group_path"), first_filled(F.col("cat_title"), F.col("pdf_title")).alias("title"),
        first_filled(F.col("cat_author"), F.col("pdf_author")).alias("author"), F.col("cat_work").alias("work"), F.col("cat_book").alias("book"),
        language_list(F.col("cat_language")).alias("language"), F.col("cat_script").alias("script"), "page_count",
        *[F.concat(F.lit(f"{k}/"), "stem", F.lit(".txt")).alias(f"{k}_file") for k in ("raw", "clean", "normalized")],
        text_hash(F.col("raw_text")).alias("raw_text_sha256"), text_hash(F.col("clean_text")).alias("clean_text_sha256"), text_hash(F.col("normalized")).alias("normalized_text_sha256"),
        "quality_flags", F.col("file_sha256").alias("source_pdf_sha256"), "ocr_model", "pipeline_version", "raw_text", "clean_text", F.col("normalized").alias("normalized_text"),
    )


def pair_rows(pages: DataFrame, run_documents: DataFrame, documents: DataFrame, text_mode: str = "clean", dpi: int = 160, selected: DataFrame | None = None) -> DataFrame:
    """The rows of image and text pairs; the image is named, its bytes are the renderer's affair."""
    if text_mode not in TEXT_MODES:
        raise ValueError("text_mode must be clean or raw")
    done = run_documents.filter("status = 'completed'").select("run_id", "document_id").distinct()
    p = unique_pages(pages).join(done, ["run_id", "document_id"], "left_semi")
    if selected is not None:
        p = p.join(selected.select("document_id"), "document_id", "left_semi")
    p = p.join(_catalog(documents), "document_id", "left")
    return p.select(
        F.col("page_id").alias("id"), "run_id", F.concat(F.lit("images/"), "page_id", F.lit(".png")).alias("image"), F.col(f"{text_mode}_text").alias("text"), "raw_text", "clean_text",
        F.lit(text_mode).alias("text_mode"), F.lit(TEXT_MODES[text_mode]).alias("label_source"), F.lit("unreviewed").alias("review_status"), "document_id",
        F.col("filename").alias("document_name"), F.col("page_num").alias("page"), F.col("cat_group_path").alias("group_path"), first_filled(F.col("cat_title"), F.col("pdf_title")).alias("title"),
        language_or(language_list(F.col("cat_language")), F.col("detected_languages")).alias("language"), first_filled(F.col("cat_script"), F.col("primary_script")).alias("script"),
        F.col("status").alias("ocr_status"), "validation_issues", "extraction_mode", "extraction_attempt", "dpi_used", F.lit(dpi).alias("render_dpi"),
        F.col("file_sha256").alias("source_pdf_sha256"), F.col("model_used").alias("ocr_model"), "pipeline_version", hash_split(first_filled(F.col("file_sha256"), F.col("document_id"))).alias("split"),
    )


def _mixed_blocks(text: Column, direction: Column) -> Column:
    """For a page of mixed direction its text with the right-to-left blocks marked, else null."""
    return wrap_blocks(F.when(direction == "mixed", F.coalesce(text, F.lit(""))))


def direction_wrap(text: Column, direction: Column, mixed: Column | None = None) -> Column:
    """Right-to-left text inside an element that says so; of mixed text only the blocks that are, each judged by its own characters."""
    body = F.coalesce(text, F.lit(""))
    blocks = _mixed_blocks(text, direction) if mixed is None else mixed
    return F.when(direction == "rtl", F.concat(F.lit('<div dir="rtl">\n\n'), body, F.lit("\n\n</div>"))).when(direction == "mixed", blocks).otherwise(body)


def _markdown() -> Column:
    """Front matter and one section per page from gathered pages and the catalog's filename."""

    def section(x: Column) -> Column:
        head = F.format_string(
            "<!-- Page %d | direction: %s | script: %s | tokens: %s | status: %s -->", x["page_num"], F.coalesce(x["script_direction"], F.lit("undetermined")),
            F.coalesce(x["primary_script"], F.lit("undetermined")), F.coalesce(x["token_count_cl100k"].cast("string"), F.lit("0")), x["status"],
        )
        return F.concat(head, F.lit("\n"), direction_wrap(x["clean_text"], x["script_direction"], x["wrapped"]))

    body = F.array_join(F.transform("p", section), "\n\n---\n\n")
    front = F.format_string("---\nsource: %s\npages: %d\nmodel: %s\npipeline_version: %s\n---\n", "filename", F.size("p"), F.array_min(_all("model_used")), F.array_min(_all("pipeline_version")))
    return F.concat(front, body)


def markdown_documents(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """``run_id, document_id, markdown``: front matter and one section per page, right-to-left text marked."""
    shown = pages.withColumn("wrapped", _mixed_blocks(F.col("clean_text"), F.col("script_direction")))
    p = _gathered(shown, "clean_text", "wrapped", "status", "script_direction", "primary_script", "token_count_cl100k", "pipeline_version", "model_used")
    return p.join(documents.select("document_id", "filename").dropDuplicates(["document_id"]), "document_id").select("run_id", "document_id", _markdown().alias("markdown"))


# ---------------------------------------------------------------- writers


def _swap(temporary: Path, target: Path) -> None:
    """Put a finished folder in the place of an older one; the older one is moved away first and dropped last, or put back."""
    old = target.with_name(f"{target.name}.old")
    shutil.rmtree(old, ignore_errors=True)
    if target.exists():
        target.replace(old)
    try:
        temporary.replace(target)
    except OSError:
        if old.exists():
            old.replace(target)
        raise
    shutil.rmtree(old, ignore_errors=True)


def export_scope(selected: list[str] | None) -> str:
    """``all``, or twelve digits that tell a selection of ids whatever its order."""
    return hashlib.sha256(",".join(sorted(selected)).encode("utf-8")).hexdigest()[:12] if selected else "all"


def export_name(kind: str, selected: list[str] | None = None, text_mode: str = "clean", dpi: int = 160) -> str:
    """The folder of an export of pairs or of a text bundle, one for each scope."""
    return f"ocr_pairs_{text_mode}_{dpi}_{export_scope(selected)}" if kind == "ocr_pairs" else f"{kind}_{export_scope(selected)}"


def _manifest(folder: Path, **values) -> None:
    (folder / "manifest.json").write_text(json.dumps(values, indent=2, ensure_ascii=False), encoding="utf-8")


def zip_folder(folder: Path) -> Path:
    """All files of a folder, in order of name, in one archive beside it. The archive is a single file, so the driver writes it."""
    bundle = folder.with_suffix(".zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(folder.rglob("*")):
            if p.is_file() and not p.name.startswith((".", "_")):
                z.write(p, p.relative_to(folder))
    return bundle


def write_dataset(pages: DataFrame, documents: DataFrame, run_id: str, folder: str) -> Path:
    """The Parquet dataset of one run below ``folder``; returns the archive."""
    target = Path(folder)
    temporary = target.with_name(target.name + ".tmp")
    shutil.rmtree(temporary, ignore_errors=True)
    own = pages.filter(F.col("run_id") == run_id)
    page_rows, document_rows = dataset_pages(own, documents), dataset_documents(own, documents)
    page_rows.write.parquet(str(temporary / "pages.parquet"))
    document_rows.write.parquet(str(temporary / "documents.parquet"))
    spark = pages.sparkSession
    _manifest(
        temporary, export_id=f"run-{run_id}", run_id=run_id, schema_version=2, split_strategy={"method": "sha256_bucket", "ratios": {"train": 0.9, "validation": 0.05, "test": 0.05}},
        documents_count=spark.read.parquet(str(temporary / "documents.parquet")).count(), pages_count=spark.read.parquet(str(temporary / "pages.parquet")).count(),
        artifacts={"pages_parquet": "pages.parquet", "documents_parquet": "documents.parquet"}, columns={"pages": page_rows.columns, "documents": document_rows.columns},
    )
    _swap(temporary, target)
    return zip_folder(target)


def write_texts(rows: DataFrame, folder: str, path: str, text: str) -> None:
    """One UTF-8 file per row, written where the rows are; ``folder`` must be shared by driver and executors."""

    def put(part) -> None:
        for r in part:
            target = os.path.join(folder, r[0])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target + ".part", "w", encoding="utf-8") as f:
                f.write(r[1] or "")
            os.replace(target + ".part", target)

    rows.select(path, text).foreachPartition(put)


def write_bundle(pages: DataFrame, run_documents: DataFrame, documents: DataFrame, run_id: str, folder: str, selected: DataFrame | None = None) -> Path:
    """The text bundle of one run; KeyError for a selected document the run does not hold."""
    links = run_documents.filter(F.col("run_id") == run_id)
    if selected is not None and (lost := missing_selection(selected, links)) is not None:
        raise KeyError(lost)
    target = Path(folder)
    temporary = target.with_name(target.name + ".tmp")
    shutil.rmtree(temporary, ignore_errors=True)
    own = pages.filter(F.col("run_id") == run_id)
    page_rows, document_rows = bundle_pages(own, links, documents, selected), bundle_documents(own, links, documents, selected).persist()
    page_rows.write.option("ignoreNullFields", "false").json(str(temporary / "pages.jsonl"))
    document_rows.drop("raw_text", "clean_text", "normalized_text").write.option("ignoreNullFields", "false").json(str(temporary / "documents.jsonl"))
    for layer in ("raw", "clean", "normalized"):
        write_texts(document_rows, str(temporary), f"{layer}_file", f"{layer}_text")
    _manifest(
        temporary, export_type="text_bundle", run_id=run_id, schema_version=1, documents_count=document_rows.count(), pages_count=page_rows.count(),
        artifacts={"clean_text_dir": "clean/", "raw_text_dir": "raw/", "normalized_text_dir": "normalized/", "pages_jsonl": "pages.jsonl", "documents_jsonl": "documents.jsonl"},
    )
    document_rows.unpersist()
    _swap(temporary, target)
    return zip_folder(target)


def write_pairs(rows: DataFrame, run_id: str, folder: str, text_mode: str = "clean", dpi: int = 160) -> Path:
    """Image and text pairs of one run by split; rows with an ``image_bytes`` column also leave their images."""
    target = Path(folder)
    temporary = target.with_name(target.name + ".tmp")
    shutil.rmtree(temporary, ignore_errors=True)
    own = rows.filter(F.col("run_id") == run_id)
    if "image_bytes" in own.columns:
        own = own.withColumn("image_sha256", F.sha2("image_bytes", 256))

        def put(part) -> None:
            for r in part:
                path = os.path.join(str(temporary), r[0])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(r[1])

        own.select("image", "image_bytes").foreachPartition(put)
        own = own.drop("image_bytes")
    own.write.option("ignoreNullFields", "false").partitionBy("split").json(str(temporary / "rows"))
    _manifest(
        temporary, export_type="ocr_pairs", run_id=run_id, pages_count=own.count(), image_format="png", dpi=dpi, text_mode=text_mode, label_source=TEXT_MODES[text_mode],
        review_status="unreviewed", schema_version=1, split_strategy={"method": "sha256_bucket", "key": "source_pdf_sha256", "ratios": {"train": 0.9, "validation": 0.05, "test": 0.05}}, splits=["train", "validation", "test"],
    )
    _swap(temporary, target)
    return zip_folder(target)


