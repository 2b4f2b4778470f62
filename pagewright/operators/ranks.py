"""Dense numbering and running totals within groups that may hold most of the rows.

A window over the group alone would put a hot group into one task. The first two functions cut each
group into hash buckets, number inside (group, bucket), and add the offsets of the
buckets before; the offsets come from one row per (group, bucket). Where the numbers must follow an order, ranges of that order
take the place of the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.tables import settle


def running_total(
    df: DataFrame, group: list[str], value: Column, order: list[str], buckets: int, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group before this row.

    ``order`` must identify a row inside its group. The order of rows is by hash bucket, then ``order``.
    """
    bucket, size, base = f"__b_{out}", f"__v_{out}", f"__base_{out}"
    cut = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")).withColumn(
        size, value.cast("bigint")
    )
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, bucket).agg(F.sum(size).alias(base))
    across = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, bucket, F.coalesce(F.sum(base).over(across), F.lit(0)).alias(base))
    return (
        cut.withColumn(out, F.coalesce(F.sum(size).over(inner), F.lit(0)))
        .join(offsets, [*group, bucket])
        .withColumn(out, F.col(out) + F.col(base))
        .drop(bucket, size, base)
    )


def group_rank(df: DataFrame, group: list[str], order: list[str], buckets: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, … within each group."""
    return running_total(df, group, F.lit(1), order, buckets, out)


def ordered_rank(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: 1, 2, 3, … within each group by ``order``, which must tell the rows of a group apart.

    Rows are put into ranges of (group, order), so a hot group is spread over many; each range is numbered by itself and
    the rows of its group in the ranges before it are added.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(df.repartitionByRange(ranges, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = placed.withColumn(out, F.row_number().over(Window.partitionBy(*group, "__range").orderBy(*order)).cast("bigint"))
    sizes = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return inside.join(sizes.select(*group, "__range", before.alias("__before")), [*group, "__range"]).withColumn(out, F.col(out) + F.col("__before")).drop("__range", "__before")
