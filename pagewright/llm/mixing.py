"""Mixing sources to target weights (problem 8).

The texts of each source are laid end to end and cut into blocks of equal length. The size of the mixture is the
largest at which no source repeats a block more often than it may. Output shards draw how many blocks each
source gives (multinomial, conditioned on the totals that meet the shares), the n-th slot of a source is sent through a pseudorandom
permutation of its block numbers, anew for each pass, and slots meet blocks in a join by number. Shards are drawn in tasks, so the
driver holds one row per source whatever the size of the mixture.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.inputs import slug
from pagewright.llm.tokens import TOKENIZER, token_counts
from pagewright.operators.ranks import running_total
from pagewright.sources.tables import settle, table

BLOCK_TOKENS = 512
SHARD_SLOTS = 4096
#: Shards of one group; a group's counts follow from the shares, those of its shards are drawn where they are used.
GROUP_SHARDS = 16
SEED = 20_240_229


def _mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """Where a pseudorandom permutation of 0 … size-1, chosen by ``key``, sends each index.

    A balanced Feistel network over the next even number of bits; what falls outside walks on until inside.
    """
    if size <= 1:
        return np.zeros_like(index)
    half = max(1, -(-int(size - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for r in range(rounds):
                salt = _mix64(np.array([(key * 1_000_003 + r * 7_919 + 1) % (1 << 64)], np.uint64))[0]
                left, right = right, left ^ (_mix64(right + salt) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= size]
    return out.astype(np.int64)


def quotas(sizes: dict[str, int], targets: list[tuple[str, float, int]], block: int) -> dict[str, tuple[int, int]]:
    """``source -> (blocks, slots)``: the largest mixture that keeps the shares and the repeats.

    Sources without text cannot hold a share; the others keep their proportions to each other.
    """
    usable = [(s, w, r) for s, w, r in targets if sizes.get(s, 0) > 0 and w > 0 and r > 0]
    total = sum(w for _, w, _ in usable)
    if not usable:
        return {}
    tokens = min(r * sizes[s] / (w / total) for s, w, r in usable)
    out = {}
    for s, w, r in usable:
        blocks = -(-sizes[s] // block)
        per_block = sizes[s] / blocks
        out[s] = (blocks, min(r * blocks, round(tokens * (w / total) / per_block)))
    return out


def group_counts(slots: list[int], group: int, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot, slots) of each source in one of ``groups`` groups: equal parts, so that all groups together hold every slot once."""
    first = np.array([n * group // groups for n in slots], np.int64)
    return first, np.array([n * (group + 1) // groups for n in slots], np.int64) - first


def draw_shards(first: np.ndarray, left: np.ndarray, shard_slots: int, shard: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, first slot, slots) of each source for the shards of one group, numbered from ``shard``.

    The group is cut into as few shards as hold it, of equal size; counts are multinomial, given that they add up to ``left``.
    """
    rng = np.random.default_rng([seed, shard])
    total = int(left.sum())
    shards = -(-total // shard_slots)
    for k in range(shards):
        size = total * (k + 1) // shards - total * k // shards
        take = left.copy() if k == shards - 1 else rng.multivariate_hypergeometric(left, size, method="marginals")
        yield shard + k, first, take
        first, left = first + take, left - take


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], block: int = BLOCK_TOKENS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``sizes(doc_id, source, n_tokens)`` -> ``shard, position, source, block, pass, doc_id, token_start, token_count``.

    Each row is the part of a document that one slot of the mixture takes. No part appears more often than its
    source's ``max_repeats``. Sources without a target, texts of no tokens and null ids take no part; a target without text
    gets no slots; repeated rows count once.
    """
    spark = sizes.sparkSession
    targets = [(s, float(w or 0), int(r or 0)) for s, w, r in targets]
    # several hot sources: numbering inside hash buckets of each source
    rows = sizes.filter(F.col("source").isin(*[s for s, _, _ in targets]) & (F.col("n_tokens") > 0)).dropDuplicates(["doc_id"])
    rows = settle(rows.select("doc_id", "source", "n_tokens"), "sizes")
    buckets = max(16, rows.count() // 2_000_000)
    placed = settle(running_total(rows, ["source"], F.col("n_tokens"), ["doc_id"], buckets, "before"), "placed")
    have = {r[0]: r[1] for r in placed.groupBy("source").agg(F.sum("n_tokens")).collect()}
    quota = quotas(have, targets, block)
    total = sum(n for _, n in quota.values())
    names = sorted(quota)
    blocks, wanted = [quota[s][0] for s in names], [quota[s][1] for s in names]
    # a group may hold a slot of each source more than its even part, so shards are numbered with room for one more
    groups = max(1, -(-total // (GROUP_SHARDS * shard_slots)))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in b.column(0).to_pylist():
                for shard, first, take in draw_shards(*group_counts(wanted, group, groups), shard_slots, group * (GROUP_SHARDS + 1), seed):
                    position = permute(np.arange(int(take.sum())), int(take.sum()), seed + 15_485_863 * (shard + 1))
                    at = np.concatenate([[0], np.cumsum(take)])
                    for i in np.flatnonzero(take):
                        j = np.arange(first[i], first[i] + take[i])
                        passes, index = j // blocks[i], np.empty(len(j), np.int64)
                        for p in np.unique(passes):
                            own = passes == p
                            index[own] = permute(j[own] % blocks[i], blocks[i], seed + 1_009 * int(i) + 104_729 * int(p))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(j), shard, np.int64)), pa.array(position[at[i] : at[i + 1]]), pa.array([names[i]] * len(j), pa.string()), pa.array(index), pa.array(passes.astype(np.int32))],
                            names=["shard", "position", "source", "block", "pass"],
                        )

    # about a million slots a task, but no task without a group
    tasks = max(1, min(groups, max(spark.sparkContext.defaultParallelism, total // 1_000_000)))
    asked = spark.range(0, groups if total else 0, 1, tasks).mapInArrow(slots, "shard bigint, position bigint, source string, block bigint, pass int")
    end = F.col("before") + F.col("n_tokens")
    parts = placed.filter(F.col("source").isin(*quota)) if quota else placed.limit(0)
    parts = parts.select(
        "source", "doc_id", "before", end.alias("end"),
        F.explode(F.sequence(F.expr(f"before div {block}"), F.expr(f"(before + n_tokens - 1) div {block}"))).alias("block"),
    ).select(
        "source", "block", "doc_id",
        (F.greatest(F.col("before"), F.col("block") * block) - F.col("before")).alias("token_start"),
        (F.least(F.col("end"), (F.col("block") + 1) * block) - F.greatest(F.col("before"), F.col("block") * block)).alias("token_count"),
    )
    # the planner takes the slots for as small as the draws they grow from and would broadcast them
    return asked.hint("merge").join(parts, ["source", "block"]).select("shard", "position", "source", "block", "pass", "doc_id", "token_start", "token_count")


def _targets(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    """The target table: one row per source by definition; rows that name no source are left out."""
    rows = table(spark, sf_dir, "mix_targets", "source", "target_share", "max_repeats")
    rows = rows.filter(F.length(F.trim("source")) > 0).groupBy(slug(F.col("source")).alias("source"))
    rows = rows.agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("w"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("r"))
    return [tuple(r) for r in rows.orderBy("source").collect()]


def source_sizes(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document, exactly."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").filter("doc_id is not null")
    return token_counts(docs.withColumn("source", slug(F.col("source"))), "text", ["doc_id", "source"], tokenizer)


# ---------------------------------------------------------------- queries


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slot of the mixture with the parts of documents it holds."""
    return mix(source_sizes(spark, sf_dir), _targets(spark, sf_dir))


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By source with a target: whether no part of a text comes more often than it may, and whether the share is met within a hundredth.

    Sources without any text hold no share; the others keep their proportions to each other.
    """
    targets = _targets(spark, sf_dir)
    mixed = settle(p8_mixture(spark, sf_dir), "mixture")
    often = mixed.groupBy("source", "doc_id", "token_start").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    tokens = {r[0]: r[1] for r in mixed.groupBy("source").agg(F.sum("token_count")).collect()}
    total, share = sum(tokens.values()), sum(w for s, w, _ in targets if s in tokens)
    rows = [(s, int(r), s not in tokens or abs(tokens[s] / total - w / share) <= 0.01) for s, w, r in targets]
    goal = spark.createDataFrame(rows, "source string, max_repeats int, share_kept boolean")
    return goal.join(often, "source", "left").select("source", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("repeats_kept"), "share_kept")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share, tokens and repeats of every source that has a target."""
    targets = _targets(spark, sf_dir)
    goal = spark.createDataFrame([(s, float(w), int(r)) for s, w, r in targets], "source string, target_share double, max_repeats int")
    mixed = settle(p8_mixture(spark, sf_dir), "mixture")
    got = mixed.groupBy("source").agg(F.sum("token_count").alias("tokens"), F.count_distinct("doc_id").alias("documents"), (F.max("pass") + 1).alias("most_repeats"))
    total = mixed.agg(F.sum("token_count")).first()[0] or 1
    return (
        goal.join(got, "source", "left")
        .select(
            "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
            (F.coalesce("tokens", F.lit(0)) / F.lit(total)).alias("actual_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
    )


P8_INVARIANTS_SQL = "SELECT DISTINCT lower(trim(source)) AS source, true AS repeats_kept, true AS share_kept FROM mix_targets WHERE trim(coalesce(source, '')) <> ''"
