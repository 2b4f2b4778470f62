"""Table access and intermediate tables shared by every plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one Parquet table; with ``columns`` only those reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, else the checkpoint folder the context was given.

    Where neither is set, as in tests, a temporary folder is made and removed at exit; on a cluster, where it would be no
    shared one, this is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    own = getattr(spark, "_pagewright_dir", None)
    if own is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder shared by all executors of {master}")
        own = tempfile.mkdtemp(prefix="pagewright-")
        spark._pagewright_dir = own
        atexit.register(shutil.rmtree, own, True)
    return own


def local_shared_dir(spark: SparkSession) -> str:
    """The shared folder as a path that Python can open; only a mounted file system has one."""
    folder = shared_dir(spark)
    if "://" in folder and not folder.startswith("file://") or folder.startswith(("hdfs:", "s3")):
        raise ValueError(f"{folder} is not on a mounted file system")
    return "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else folder


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts the lineage, survives the loss of executors and, being
    columnar, is narrower on disk than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def commit(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by ``df`` and read it back.

    The rows, which may be made from the table itself, are written beside it first; then the old table is moved away, the new one
    put in its place and the old one dropped, so at every moment one of them is whole. If the second move fails the first is undone.
    """
    spark = df.sparkSession
    path = path.rstrip("/")
    mark = uuid.uuid4().hex
    fresh, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    df.write.parquet(fresh)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(hadoop(path))
    if there and not fs.rename(hadoop(path), hadoop(old)):
        fs.delete(hadoop(fresh), True)
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(hadoop(fresh), hadoop(path)):
        if there:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"{fresh} cannot be moved to {path}")
    if there:
        fs.delete(hadoop(old), True)
    return spark.read.schema(df.schema).parquet(path)


_written: list[tuple[SparkSession, str]] = []


def _drop_at_exit(spark: SparkSession, path: str) -> None:
    if not _written:
        atexit.register(_drop_written)
    _written.append((spark, path))


def _drop_written() -> None:
    for spark, path in _written:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone already
            pass
