"""Pairs of members of the same group, in blocks, for outputs that are pairs by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _block(ident: str, blocks: str):
    """The block of a member, by hash; a group of k blocks' size is cut into k of about equal size."""
    return F.pmod(F.xxhash64(ident), F.col(blocks)).cast("int")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as the session shuffles into.

    What is joined block against block is small while its result is not; left to itself the planner would merge the blocks of a hot group, by
    their bytes, into one task again.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pairs_across(members: DataFrame, key: str, ident: str, side: str, block: int = 512, extra: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one group whose ``side`` differs: ``key``, ``<ident>_a`` < ``<ident>_b``, ``extra`` of both.

    The members of a (key, side) are cut into blocks of about ``block`` rows; a task joins
    one block with another, so a group of any size is spread over the cluster. Only groups
    with at least two sides enter; ``side`` is a label of few values, such as a split. Rows with a null key, ident or side name
    no group and pair with nothing; repeated rows count once.
    """
    more = [f"x{i}" for i in range(len(extra))]
    m = members.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.col(side).alias("side"), *[F.col(c).alias(x) for c, x in zip(extra, more)])
    m = m.dropna(subset=["key", "id", "side"]).dropDuplicates(["key", "id", "side"])
    sides = m.groupBy("key", "side").agg(F.count(F.lit(1)).alias("n"))
    listed = (
        sides.groupBy("key")
        .agg(F.collect_list(F.struct(F.col("side").alias("s"), F.ceil(F.col("n") / block).cast("int").alias("k"))).alias("all"))
        .filter(F.size("all") > 1)
    )
    sized = listed.select("key", F.explode("all").alias("x")).select("key", F.col("x.s").alias("side"), F.col("x.k").alias("k"))
    numbered = m.join(sized, ["key", "side"]).withColumn("block", _block("id", "k"))
    # one row per pair of blocks of two sides
    plan = (
        listed.select("key", F.explode("all").alias("x"), "all")
        .select("key", "x", F.explode("all").alias("y"))
        .filter(F.col("x.s") < F.col("y.s"))
        .select("key", F.col("x.s").alias("sa"), F.col("y.s").alias("sb"), F.explode(F.sequence(F.lit(0), F.col("x.k") - 1)).alias("ba"), F.col("y.k").alias("kb"))
        .select("key", "sa", "sb", "ba", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("bb"))
    )
    left = numbered.select("key", F.col("side").alias("sa"), F.col("block").alias("ba"), F.col("id").alias("ia"), *[F.col(x).alias(f"{x}a") for x in more])
    right = numbered.select("key", F.col("side").alias("sb"), F.col("block").alias("bb"), F.col("id").alias("ib"), *[F.col(x).alias(f"{x}b") for x in more])
    joined = spread(plan.join(left, ["key", "sa", "ba"]), "key", "sb", "bb").join(right, ["key", "sb", "bb"]).filter("ia <> ib")
    first = F.col("ia") < F.col("ib")
    out = [F.col("key").alias(key), F.least("ia", "ib").alias(f"{ident}_a"), F.greatest("ia", "ib").alias(f"{ident}_b")]
    for c, x in zip(extra, more):
        a, b = F.col(f"{x}a"), F.col(f"{x}b")
        out += [F.when(first, a).otherwise(b).alias(f"{c}_a"), F.when(first, b).otherwise(a).alias(f"{c}_b")]
    return joined.select(*out)


def pairs_within(members: DataFrame, key: str, ident: str, form: str, block: int = 512) -> DataFrame:
    """All pairs of one group whose ``form`` differs: ``<ident>_a`` < ``<ident>_b``.

    For forms of any number, such as digests. Groups of a single form are dropped before any
    member is moved; the rest is joined block against block. Rows with a null in
    key, ident or form pair with nothing; repeated rows count once.
    """
    m = members.select(F.col(key).alias("key"), F.col(ident).alias("id"), F.col(form).alias("form")).dropna().dropDuplicates()
    groups = (
        m.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("form").alias("lo"), F.max("form").alias("hi"))
        .filter("lo <> hi")
        .select("key", F.ceil(F.col("n") / block).cast("int").alias("k"))
    )
    numbered = m.join(groups, "key").withColumn("block", _block("id", "k"))
    plan = groups.select("key", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("ba")).select("key", "ba", F.explode(F.sequence("ba", F.col("k") - 1)).alias("bb"))
    left = numbered.select("key", F.col("block").alias("ba"), F.col("id").alias("ia"), F.col("form").alias("fa"))
    right = numbered.select("key", F.col("block").alias("bb"), F.col("id").alias("ib"), F.col("form").alias("fb"))
    joined = spread(plan.join(left, ["key", "ba"]), "key", "bb").join(right, ["key", "bb"])
    # inside a block each pair comes twice, across blocks once
    once = (F.col("ba") < F.col("bb")) | (F.struct("ia", "fa") < F.struct("ib", "fb"))
    return joined.filter(once & (F.col("fa") != F.col("fb")) & (F.col("ia") != F.col("ib"))).select(F.least("ia", "ib").alias(f"{ident}_a"), F.greatest("ia", "ib").alias(f"{ident}_b"))
