"""Files as tables: listings, hashes, text artifacts, ingestion."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_pdfs(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> DataFrame:
    """``path, name, size, modified`` of the PDF files of a folder, whatever the case of the suffix; with ``documents`` the name the catalog has.

    Only the listing is read, not the files. Files of no bytes hold no page and are not listed.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    listed = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    listed = listed.withColumn("name", F.element_at(F.split("path", "/"), -1))
    if documents is not None:
        known = documents.select(F.col("source_path").alias("path"), F.col("filename").alias("__f")).dropDuplicates(["path"])
        listed = listed.join(known, "path", "left").withColumn("name", F.coalesce("__f", "name")).drop("__f")
    return listed.orderBy("path")


def expand_inputs(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """``path, name, size, modified`` of the PDF files that are named or lie in the folders that are; each file once, in order of path.

    What does not exist, or is a file of another kind, is passed over.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in dict.fromkeys(inputs) if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(there) if there else None
    if files is None:
        return spark.createDataFrame([], "path string, name string, size bigint, modified timestamp")
    path = F.regexp_replace("path", "^file:/*", "/")
    listed = files.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return listed.dropDuplicates(["path"]).orderBy("path")


def store_uploads(uploads: DataFrame, folder: str) -> DataFrame:
    """``filename, stored, path, size, file_sha256, document_id, refused`` of ``uploads(filename, content)``, each file written below ``folder``.

    A file is stored as the first 16 digits of its hash, two underscores and its bare name, so the same content under the same name is one
    file. Names without the suffix ``.pdf`` or with two dots in a row, a null name and null content are refused and not written. ``folder`` must be shared by
    driver and executors.
    """
    name = F.regexp_replace(F.coalesce("filename", F.lit("")), r"^.*[/\\]", "")
    refused = ~F.lower(name).endswith(".pdf") | F.contains(name, F.lit("..")) | F.col("content").isNull()
    sha = F.sha2("content", 256)
    rows = uploads.select(name.alias("filename"), F.when(~refused, F.concat(F.substring(sha, 1, 16), F.lit("__"), name)).alias("stored"), "content", sha.alias("file_sha256"), refused.alias("refused"))

    def put(part) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in part:
            target = os.path.join(folder, r[0])
            with open(f"{target}.{os.getpid()}.part", "wb") as f:
                f.write(r[1])
            os.replace(f"{target}.{os.getpid()}.part", target)

    rows.filter("not refused").select("stored", "content").foreachPartition(put)
    path = F.when(~F.col("refused"), F.concat(F.lit(folder.rstrip("/") + "/"), "stored"))
    return rows.select("filename", "stored", path.alias("path"), F.octet_length("content").cast("bigint").alias("size"), "file_sha256", F.substring("file_sha256", 1, 16).alias("document_id"), "refused")


def hash_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, size, sha256, document_id`` by content; the id is the first 16 digits of the hash. Files of no bytes give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    hashed = files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return hashed.withColumn("document_id", F.substring("sha256", 1, 16))


def read_texts(spark: SparkSession, paths: DataFrame, column: str, folder: str) -> DataFrame:
    """``paths`` with ``text``: the content of the file each path names below ``folder``, empty where there is none."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias(column), F.col("value").alias("text"))
    return paths.join(files, column, "left").withColumn("text", F.coalesce("text", F.lit("")))
