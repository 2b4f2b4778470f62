"""The catalog of documents and runs: lookups, joins, upserts, patches, sweeps, lists.

A table is a DataFrame; every change returns the changed table, to be written elsewhere and swapped in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.classes import strip
from pagewright.functions.labels import filled, first_filled
from pagewright.operators.ranks import ordered_rank

#: Columns a metadata patch may change.
PATCHABLE = (
    "display_title", "group_path", "author", "work", "book", "document_date_label", "document_date_precision", "language",
    "script", "license", "source_citation", "notes", "tags_json",
)
COMPLETE = ("author", "work", "document_date_label", "document_date_precision", "language", "script", "license")
SEARCHED = ("display_title", "filename", "group_path", "author", "work", "book", "document_date_label", "language", "script")
UPSERT_KEEPS_OLD = ("total_pages", "pdf_title", "pdf_author", "pdf_creation_date", "pdf_producer")
UPSERT_TAKES_NEW = ("filename", "source_path", "file_size_bytes", "last_seen_at")
OPEN = ("queued", "processing")


def display_title() -> Column:
    return first_filled(F.col("display_title"), F.col("pdf_title"), F.col("filename"))


def metadata_complete() -> Column:
    """1 where every field a dataset wants is filled, else 0."""
    complete = F.lit(True)
    for c in COMPLETE:
        complete = complete & F.coalesce(F.col(c) != "", F.lit(False))
    return F.when(complete, 1).otherwise(0)


def latest_runs(run_documents: DataFrame, runs: DataFrame) -> DataFrame:
    """``document_id, latest_run_id, latest_run_status``: the last created run of each document, of equals the greater id."""
    linked = run_documents.select("document_id", "run_id").distinct()
    known = runs.select(F.col("id").alias("run_id"), F.col("created_at").alias("c"), F.col("status").alias("s"))
    best = F.max_by(F.struct("run_id", "s"), F.struct("c", "run_id")).alias("r")
    return linked.join(known, "run_id").groupBy("document_id").agg(best).select("document_id", F.col("r.run_id").alias("latest_run_id"), F.col("r.s").alias("latest_run_status"))


def process_label(status: Column) -> Column:
    return F.when(status == "completed", "processed").when(status.isin(*OPEN), "running").when(status == "failed", "failed").otherwise("never")


def newest(df: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The last rows by time, of equals by key; nulls come last. A top-k of bounded size."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(key)).limit(limit)


def search(documents: DataFrame, query: str = "", group: str = "") -> DataFrame:
    """Documents of a group that hold the query, whatever its case, in any described field."""
    found = documents
    if group:
        found = found.filter(strip(F.coalesce("group_path", F.lit(""))) == group)
    q = query.strip().lower()
    if q:
        hit = F.lit(False)
        for c in SEARCHED:
            hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
        found = found.filter(hit)
    return found


def group_name() -> Column:
    return first_filled(strip(F.coalesce("group_path", F.lit(""))), F.lit("Ungrouped"))


def missing(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not known."""
    return wanted.select(key).distinct().join(known.select(key), key, "left_anti")


def upsert_documents(documents: DataFrame, incoming: DataFrame, key: str = "document_id") -> DataFrame:
    """Merge newly seen files: file facts are overwritten, PDF facts only by values, curated fields and the first sight stay.

    ``incoming`` has one row per key and the columns named above; other columns of new rows are null.
    """
    new = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in (*UPSERT_TAKES_NEW, *UPSERT_KEEPS_OLD)], F.lit(True).alias("__new"))
    joined = documents.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    out = []
    for f in documents.schema:
        c = f.name
        if c in UPSERT_TAKES_NEW:
            value = F.when(F.col("__new"), F.col(f"__new_{c}")).otherwise(F.col(c))
        elif c in UPSERT_KEEPS_OLD:
            value = F.coalesce(F.col(f"__new_{c}"), F.col(c))
        elif c == "first_seen_at":
            value = F.when(F.col("__old").isNull(), F.col("__new_last_seen_at")).otherwise(F.col(c))
        else:
            value = F.col(c)
        out.append(value.cast(f.dataType).alias(c))
    return joined.select(*out)


def upsert_pages(pages: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("run_id", "document_id", "page_num")) -> DataFrame:
    """Replace whole rows by key: what an incoming row leaves out is reset, its status to pending."""
    rows = incoming
    for f in pages.schema:
        if f.name not in rows.columns:
            rows = rows.withColumn(f.name, (F.lit("pending") if f.name == "status" else F.lit(None)).cast(f.dataType))
    rows = rows.withColumn("status", F.coalesce("status", F.lit("pending"))) if "status" in pages.columns else rows
    return pages.join(rows.select(*keys), list(keys), "left_anti").unionByName(rows.select(*pages.columns))


def link_run_documents(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert links of runs and documents: status and source run are overwritten, the rest stays."""
    new = incoming.select("run_id", "document_id", F.col("status").alias("__s"), F.col("source_run_id").alias("__r"), F.lit(True).alias("__new"))
    joined = links.join(new, ["run_id", "document_id"], "full_outer")
    take = {"status": "__s", "source_run_id": "__r"}
    return joined.select(*[(F.when(F.col("__new"), F.col(take[c])).otherwise(F.col(c)) if c in take else F.col(c)).alias(c) for c in links.columns])


def patch_documents(documents: DataFrame, ids: list[str], fields: dict, now: Column, key: str = "document_id") -> DataFrame:
    """Set patchable fields of the given documents; all or nothing.

    Unknown fields are ignored; with none left nothing changes. An id that is not in the table raises KeyError with the least one.
    """
    spark = documents.sparkSession
    wanted = spark.createDataFrame([(i,) for i in sorted(set(ids))], f"{key} string")
    first = missing(wanted, documents, key).agg(F.min(key)).first()[0]
    if first is not None:
        raise KeyError(first)
    changes = {k: v for k, v in fields.items() if k in PATCHABLE}
    if not changes:
        return documents
    own = F.col(key).isin(*set(ids))
    changed = {k: F.when(own, F.lit(v)).otherwise(F.col(k)).cast(documents.schema[k].dataType) for k, v in changes.items()}
    return documents.withColumns(changed | {"catalog_updated_at": F.when(own, now).otherwise(F.col("catalog_updated_at"))})


def sweep_orphans(runs: DataFrame, run_documents: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """After a crash: open runs and their unfinished documents become failed."""
    orphan = runs.filter(F.col("status").isin(*OPEN)).select(F.col("id").alias("run_id"), F.lit(True).alias("__o"))
    lost = F.col("status").isin(*OPEN)
    swept = runs.withColumns(
        {
            "error": F.when(lost, F.coalesce("error", F.lit("Process exited before run finished"))).otherwise(F.col("error")),
            "completed_at": F.when(lost, F.coalesce("completed_at", now)).otherwise(F.col("completed_at")),
            "stage": F.when(lost, "failed").otherwise(F.col("stage")),
            "status": F.when(lost, "failed").otherwise(F.col("status")),
        }
    )
    return swept, _fail_unfinished(run_documents.join(orphan, "run_id", "left"), now).select(*run_documents.columns)


def sweep_failed_runs(runs: DataFrame, run_documents: DataFrame, now: Column) -> DataFrame:
    """Unfinished documents of failed runs become failed."""
    failed = runs.filter("status = 'failed'").select(F.col("id").alias("run_id"), F.lit(True).alias("__o"))
    return _fail_unfinished(run_documents.join(failed, "run_id", "left"), now).select(*run_documents.columns)


def _fail_unfinished(joined: DataFrame, now: Column) -> DataFrame:
    own = F.coalesce("__o", F.lit(False)) & (F.col("status") != "completed")
    done = F.when(own, F.coalesce("completed_at", now)).otherwise(F.col("completed_at"))
    return joined.withColumn("completed_at", done).withColumn("status", F.when(own, "failed").otherwise(F.col("status")))


def delete_run(run_id: str, runs: DataFrame, run_documents: DataFrame, pages: DataFrame, events: DataFrame) -> tuple[DataFrame, ...]:
    """The four tables without a run and all that hangs on it; ValueError while it is processing."""
    if runs.filter((F.col("id") == run_id) & (F.col("status") == "processing")).limit(1).count():
        raise ValueError("run is processing")
    return runs.filter(F.col("id") != run_id), *[t.filter(F.col("run_id") != run_id) for t in (run_documents, pages, events)]


def retryable(runs: DataFrame, run_documents: DataFrame, documents: DataFrame) -> DataFrame:
    """Unfinished documents of failed runs whose source is known."""
    failed = runs.filter("status = 'failed'").select(F.col("id").alias("run_id"))
    left = run_documents.filter("status != 'completed'").join(failed, "run_id", "left_semi")
    return left.join(documents.filter(F.coalesce(F.col("source_path"), F.lit("")) != "").select("document_id", "source_path"), "document_id")


def current_document(run_documents: DataFrame) -> DataFrame:
    """The document of each run to show: one processing, else waiting, else failed, each the first; else the last.

    Order is by start, unstarted last, then by document; ``position`` tells the place in it. No task holds a whole run.
    """
    ranked = ordered_rank(run_documents, ["run_id"], started_order(), "position")
    rank = F.when(F.col("status") == "processing", 0).when(F.col("status").isin("pending", "queued"), 1).when(F.col("status") == "failed", 2).otherwise(3)
    first = F.struct(rank, F.when(rank < 3, F.col("position")).otherwise(-F.col("position")))
    names = [c for c in ranked.columns if c != "run_id"]
    return ranked.groupBy("run_id").agg(F.min_by(F.struct(*names), first).alias("r")).select("run_id", "r.*")


def started_order() -> list[Column]:
    """Documents of a run by start, unstarted ones last, then by document."""
    return [F.col("started_at").asc_nulls_last(), F.col("document_id").asc()]


def selection_state(run_documents: DataFrame) -> DataFrame:
    """``run_id, all_documents, unfinished, complete``: whether all documents of each run are completed; counted, not gathered."""
    each = run_documents.groupBy("run_id", "document_id").agg(F.max(F.coalesce(F.col("status") == "completed", F.lit(False))).alias("done"))
    return each.groupBy("run_id").agg(F.count(F.lit(1)).alias("all_documents"), F.count_if(~F.col("done")).alias("unfinished")).withColumn("complete", F.col("unfinished") == 0)


def update_rows(df: DataFrame, where: Column, **values) -> DataFrame:
    """``df`` with the given columns set in the rows that meet ``where``, any column but one that is not there; other rows stay."""
    unknown = [c for c in values if c not in df.columns]
    if unknown:
        raise KeyError(unknown[0])
    own = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(own, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def dedup_uploads(incoming: DataFrame, documents: DataFrame) -> DataFrame:
    """Incoming files with ``deduped``, whether their content is known, and the filename to keep, the first one seen."""
    known = documents.select("file_sha256", F.col("filename").alias("__f")).dropDuplicates(["file_sha256"])
    joined = incoming.join(known, "file_sha256", "left")
    return joined.withColumn("deduped", F.col("__f").isNotNull()).withColumn("filename", F.coalesce("__f", "filename")).drop("__f")


def language_or(labels: Column, detected: Column) -> Column:
    """The catalog's languages, or where it has none those detected."""
    return F.when(F.size(labels) > 0, labels).otherwise(F.coalesce(detected, F.array().cast("array<string>")))


def unfilled(c: str) -> Column:
    return filled(F.col(c))
