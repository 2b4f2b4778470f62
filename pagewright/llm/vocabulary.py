"""Counts of all tokens of a text column, and the part of them that may be broadcast."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.sources.tables import settle

#: A vocabulary word makes up at least this share of all tokens, so there are at most 1 / SHARE of them.
SHARE = 2e-6
#: A word occurs at least so often.
LEAST = 4
#: Distinct tokens a worker holds before it hands its counts on.
HELD = 200_000


def token_table(df: DataFrame, text: str, cut: Callable[[str], list[str]], longest: int = 64) -> DataFrame:
    """``token, n`` over all rows of ``text``; counted in the worker first, so a token moves once per batch of pages.

    Tokens longer than ``longest`` characters are no vocabulary words and are not counted. Null texts count nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            keys = [k for k in held if len(k) <= longest]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["token", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    held.update(cut(t))
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    return df.select(text).mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def pair_key(left: Column, right: Column) -> Column:
    """The key of two neighbouring tokens in ``token_and_pair_table``."""
    crc = lambda c: F.crc32(F.encode(c, "UTF-8"))
    return F.shiftleft(crc(left), 32).bitwiseOR(crc(right))


def token_and_pair_table(df: DataFrame, text: str, cut: Callable[[str], list[str]], fold: Callable[[str], str], longest: int) -> DataFrame:
    """``token, pair, n``: the rows of ``token_table``, with ``pair`` null, and counts of neighbouring tokens, with ``token`` null.

    A pair is told by the 32-bit checksums of its two tokens, both put through ``fold``. Both are counted in the worker first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        sums: dict[str, int] = {}
        pairs: list[np.ndarray] = []
        size = 0

        def out():
            keys = [k for k in held if len(k) <= longest]
            both, times = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.nulls(len(keys), pa.int64()), pa.array([held[k] for k in keys], pa.int64())], names=["token", "pair", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(both), pa.string()), pa.array(both), pa.array(times.astype(np.int64))], names=["token", "pair", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    tokens = cut(t)
                    held.update(tokens)
                    for k in tokens:
                        if k not in sums:
                            sums[k] = zlib.crc32(fold(k).encode("utf-8", "surrogatepass"))
                    each = np.array([sums[k] for k in tokens], np.uint64)
                    pairs.append((each[:-1] << np.uint64(32) | each[1:]).view(np.int64))
                    size += len(tokens)
            if len(held) > HELD or size > 10 * HELD:
                yield from out()
                held.clear()
                sums.clear()
                pairs.clear()
                size = 0
        if held:
            yield from out()

    return df.select(text).mapInArrow(run, "token string, pair bigint, n bigint").groupBy("token", "pair").agg(F.sum("n").alias("n"))


def floor_of(counts: DataFrame, share: float = SHARE, least: int = LEAST) -> int:
    """The least count of a token that makes up ``share`` of all ``counts(…, n)``, at least ``least``."""
    return max(least, int(share * (counts.agg(F.sum("n")).first()[0] or 0)))


def frequent(counts: DataFrame, share: float = SHARE, least: int = LEAST) -> list[tuple[str, int]]:
    """Tokens that make up at least ``share`` of all, with their counts: at most 1 / share of them by definition."""
    counts = settle(counts, "tokens")
    floor = floor_of(counts, share, least)
    return [(r[0], r[1]) for r in counts.filter(F.col("n") >= floor).collect()]
