"""The event log of runs: append, replay, progress and counters, in batch and as a stream."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.sources.tables import commit

EVENT_TYPES = ("run_started", "page_start", "page_retry", "page_complete", "document_complete", "dataset_export_started", "run_complete", "run_failed")
LAST = ("run_complete", "run_failed")
#: Seconds between two looks at a log that is followed.
PAUSE = 0.5
SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("run_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("created_at", T.TimestampType())]
)


def once(events: DataFrame) -> DataFrame:
    """Each event once; repeated rows carry the same id."""
    return events.dropDuplicates(["id"])


def replay(events: DataFrame, run_id: str, after: int = 0, limit: int = 1000) -> DataFrame:
    """The next events of a run behind an id, in order: a page of bounded size."""
    return once(events.filter((F.col("run_id") == run_id) & (F.col("id") > after))).orderBy("id").limit(limit)


def progress_of(done: Column, total: Column, ended: Column) -> Column:
    """Share of pages done: 1 at the end of a completed run, below 1 before it, 0 where no total is known."""
    return F.when(ended, F.lit(1.0)).when(F.coalesce(total, F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.99), done.cast("double") / total))


def run_state(events: DataFrame) -> DataFrame:
    """Counts of events by run; works on tables and on streams alike, being one aggregation with a map-side combine."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    pages = F.when(F.col("event_type") == "document_complete", F.get_json_object("payload", "$.pages").try_cast("bigint"))
    return events.groupBy("run_id").agg(
        # a log that keeps no pages tells how many each document had
        F.greatest(kind("page_complete"), F.coalesce(F.sum(pages), F.lit(0))).alias("pages_done"), kind("page_retry").alias("retries"), kind("document_complete").alias("documents_done"),
        (kind("run_complete") > 0).alias("completed"), (kind("run_failed") > 0).alias("failed"), F.max("id").alias("last_event_id"),
    )


def with_progress(state: DataFrame, runs: DataFrame) -> DataFrame:
    """Run states with their share of pages; the totals come from the table of runs."""
    totals = runs.select(F.col("id").alias("run_id"), "pages_total")
    out = state.join(totals, "run_id", "left")
    return out.withColumn("progress", progress_of(F.col("pages_done"), F.col("pages_total"), F.col("completed")))


def lifecycle(events: DataFrame) -> DataFrame:
    """``run_id, last_event, events, status, stage``: queued, processing (ocr, then exporting), completed or failed, by the events there are, in whatever order they came."""
    kind = lambda k: F.count_if(F.col("event_type") == k) > 0
    told = events.groupBy("run_id").agg(
        F.max_by("event_type", "id").alias("last_event"), F.count(F.lit(1)).alias("events"), *[kind(k).alias(k) for k in ("run_started", "dataset_export_started", "run_complete", "run_failed")],
    )
    ended = F.when(F.col("run_failed"), "failed").when(F.col("run_complete"), "completed")
    busy = F.when(F.col("dataset_export_started"), "exporting").otherwise("ocr")
    return told.select("run_id", "last_event", "events", F.coalesce(ended, F.when(F.col("run_started"), "processing").otherwise("queued")).alias("status"), F.coalesce(ended, F.when(F.col("run_started"), busy).otherwise("queued")).alias("stage"))


def counters(events: DataFrame) -> DataFrame:
    """Counters over the whole log in one row; times in tenths of a millisecond."""
    kind = lambda k: F.count_if(F.col("event_type") == k)
    page = F.col("event_type") == "page_complete"
    status = F.coalesce(F.get_json_object("payload", "$.status"), F.get_json_object("payload", "$.validation_status"))
    tokens = F.coalesce(F.get_json_object("payload", "$.tokens"), F.get_json_object("payload", "$.token_count"), F.lit("0")).try_cast("bigint")
    ms = F.coalesce(F.get_json_object("payload", "$.processing_time_ms"), F.get_json_object("payload", "$.time_ms"), F.lit("0")).try_cast("double")
    return events.agg(
        kind("run_started").alias("jobs_created"), kind("run_complete").alias("jobs_completed"), kind("run_failed").alias("jobs_failed"),
        F.greatest(F.lit(0), kind("run_started") - kind("run_complete") - kind("run_failed")).alias("active_jobs"),
        kind("document_complete").alias("documents_processed"), kind("page_complete").alias("pages_processed"), kind("page_retry").alias("page_retries"),
        *[F.count_if(page & (status == s)).alias(f"pages_{s}") for s in ("warn", "fail", "empty")],
        F.coalesce(F.sum(F.when(page, F.coalesce(tokens, F.lit(0)))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(page, F.round(F.coalesce(ms, F.lit(0.0)) * 10).cast("bigint"))), F.lit(0)).alias("time_tenths"),
    )


def rates(counted: DataFrame) -> DataFrame:
    """Counters with tokens per second and milliseconds per page; 0 where nothing was counted."""
    seconds = F.col("time_tenths") / 10_000
    return counted.withColumns(
        {
            "tokens_per_second": F.when(seconds > 0, F.col("tokens") / seconds).otherwise(F.lit(0.0)),
            "page_latency_ms": F.when(F.col("pages_processed") > 0, seconds / F.col("pages_processed") * 1000).otherwise(F.lit(0.0)),
        }
    )


def prometheus(rated: DataFrame, prefix: str = "pages") -> DataFrame:
    """The counters as lines of text, one metric a row."""
    names = [c for c in rated.columns]
    return rated.select(F.explode(F.array(*[F.concat(F.lit(f"{prefix}_{n} "), F.col(n).cast("string")) for n in names])).alias("line"))


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """The log as a stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def follow(spark: SparkSession, folder: str, run_id: str, after: int = 0) -> DataFrame:
    """The events of one run behind an id as they arrive, each once, however late; what is remembered is the ids of this one run."""
    stream = read_stream(spark, folder).filter((F.col("run_id") == run_id) & (F.col("id") > after))
    return stream.dropDuplicates(["id"])


def follow_to_end(spark: SparkSession, folder: str, run_id: str, checkpoint: str, take: Callable[[DataFrame], None], after: int = 0, timeout: float | None = None) -> bool:
    """Hand the events of one run to ``take``, batch by batch in order of id, until the run has ended or the time is over; whether it has ended.

    An event of LAST ends it once the files at hand are read, so events written before the end are not lost to it.
    """
    ended = []

    def each(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        take(rows.orderBy("id"))
        if rows.filter(F.col("event_type").isin(*LAST)).limit(1).count():
            ended.append(True)
        rows.unpersist()

    left = timeout
    while not ended:
        query = follow(spark, folder, run_id, after).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if ended or left is not None and left <= 0:
            break
        time.sleep(PAUSE)
        left = None if left is None else left - PAUSE
    return bool(ended)


def progress_stream(spark: SparkSession, folder: str, checkpoint: str, path: str, late: str = "30 days"):
    """A running query that keeps the state of every run in the table at ``path``; only runs that changed are written.

    Ids are remembered for ``late`` behind the newest event. What comes later still is not counted by the stream; ``run_state`` over the log
    counts it.
    """
    state = run_state(read_stream(spark, folder).withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"]))

    def each(batch: DataFrame, _: int) -> None:
        merge_states(batch, path)

    return state.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_states(changed: DataFrame, path: str) -> None:
    """Put changed rows of the runs' states in the place of the old ones."""
    spark = changed.sparkSession
    changed = changed.persist()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(path)):
        kept = spark.read.schema(changed.schema).parquet(path).join(changed.select("run_id"), "run_id", "left_anti")
        commit(kept.unionByName(changed), path)
    else:
        commit(changed, path)
    changed.unpersist()


def append(events: DataFrame, folder: str) -> None:
    """Add events to the log."""
    events.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]).write.mode("append").parquet(folder)
