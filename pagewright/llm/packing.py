"""Filling fixed-capacity containers with texts measured in tokens (problem 7).

The plan works on the histogram of lengths, whose size depends on the capacity and not on the data: shallow
combinations that fill a window under the capacity are enumerated, non-negative least squares finds how often
each should repeat to use up the histogram, the counts are rounded down, and the lengths left over are packed greedily.
Every text then finds its container from its length and its rank among the texts of that length, without meeting the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.tokens import TOKENIZER, token_counts
from pagewright.operators.ranks import group_rank, running_total
from pagewright.sources.tables import settle, table

#: Lengths are planned on a grid of at most so many units per container, rounded up.
UNITS = 2048
ROUNDS = 80


@dataclass
class Plan:
    """``lengths[i]`` holds rank ranges ``lo``, the multiplicity ``take`` and the first container ``base`` of unit length i."""

    containers: int
    lo: dict[int, np.ndarray]
    take: dict[int, np.ndarray]
    base: dict[int, np.ndarray]


def combinations(units: np.ndarray, full: int, window: int) -> np.ndarray:
    """Non-decreasing combinations of one to three of ``units`` whose sum lies in [full - window, full], padded with 0."""
    units = np.sort(units)
    rows = [np.stack([np.zeros_like(units), np.zeros_like(units), units], 1)[units >= full - window]]
    a, b = np.meshgrid(units, units, indexing="ij")
    ok = (a <= b) & (a + b <= full) & (a + b >= full - window)
    rows.append(np.stack([np.zeros(ok.sum(), units.dtype), a[ok], b[ok]], 1))
    present = np.zeros(full + 1, bool)
    present[units] = True
    ok = (a <= b) & (a + 2 * b <= full)
    a, b = a[ok], b[ok]
    for gap in range(window + 1):
        c = full - gap - a - b
        good = (c >= b) & present[np.maximum(c, 0)]
        rows.append(np.stack([a[good], b[good], c[good]], 1))
    return np.concatenate(rows)


def solve_nnls(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 that minimises |W (A x - h)|^2 by accelerated projected gradient.

    A counts the units of each combination; W weighs an item left over by its length, since a long one costs most of a container
    while short ones still fill gaps.
    """
    n, size = len(combos), len(histogram)
    if not n:
        return np.zeros(0)
    flat = combos.ravel()
    weight = np.square(np.arange(size) / max(size - 1, 1))

    def forward(x: np.ndarray) -> np.ndarray:
        used = np.bincount(flat, np.repeat(x, 3), size)
        used[0] = 0
        return used

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[combos].sum(1)

    v = np.ones(n)
    for _ in range(12):
        w = back(forward(v))
        norm = np.linalg.norm(w)
        v = w / max(norm, 1e-12)
    step = 1 / max(norm * 1.05, 1e-12)
    x, y, t = np.zeros(n), np.zeros(n), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - histogram))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def plan_containers(histogram: np.ndarray, full: int, window: int = 1) -> Plan:
    """The plan for ``histogram[u]`` items of u units each and containers of ``full`` units.

    Steps and result are bounded by ``full``, whatever the number of items.
    """
    left = histogram.astype(np.int64).copy()
    rows: list[tuple[int, int, int, int]] = []  # unit, first rank, take, first container
    used = np.zeros(full + 1, np.int64)
    made = 0

    def place(pattern: dict[int, int], repeats: int) -> None:
        nonlocal made
        for u, take in pattern.items():
            rows.append((u, used[u], take, made))
            used[u] += take * repeats
            left[u] -= take * repeats
        made += repeats

    present = np.flatnonzero(left)
    combos = combinations(present, full, window)
    x = solve_nnls(combos, left.astype(float))
    order = np.argsort(-x)
    for i in order[x[order] >= 1]:
        pattern: dict[int, int] = {}
        for u in combos[i]:
            if u:
                pattern[int(u)] = pattern.get(int(u), 0) + 1
        repeats = min([int(x[i]), *(int(left[u]) // take for u, take in pattern.items())])
        if repeats:
            place(pattern, repeats)
    # what is left: longest first, as many of each length as fit, the same filling as often as the counts allow
    while True:
        lengths = np.flatnonzero(left)
        if not len(lengths):
            break
        room, at, pattern = full, len(lengths) - 1, {}
        while at >= 0:
            at = int(np.searchsorted(lengths[: at + 1], room, "right")) - 1
            if at < 0:
                break
            u = int(lengths[at])
            pattern[u] = min(int(left[u]), room // u)
            room -= u * pattern[u]
            at -= 1
        place(pattern, min(int(left[u]) // take for u, take in pattern.items()))
    by: dict[int, list] = {}
    for u, lo, take, base in rows:
        by.setdefault(u, []).append((lo, take, base))
    return Plan(
        made,
        *({u: np.array([r[k] for r in v], np.int64) for u, v in by.items()} for k in range(3)),
    )


def fill_containers(sizes: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """``sizes(doc_id, n_tokens)`` -> ``container, container_no, doc_id, piece, token_start, token_count`` for each capacity.

    A text within the capacity is one piece in one container. A longer one is cut into pieces that
    fill a container each and a rest, which is packed like a short text. Texts of no tokens, and null sizes, take no
    place and give no row; repeated rows count once; an empty table gives an empty result.
    """
    sizes = sizes.select("doc_id", "n_tokens").filter("n_tokens > 0").dropDuplicates(["doc_id"])
    choices = [
        F.struct(F.lit(str(n)).alias("container"), F.lit(int(c)).cast("bigint").alias("capacity"), F.lit(int(-(-c // UNITS))).cast("bigint").alias("grain"))
        for n, c in capacities
    ]
    each = sizes.select("doc_id", "n_tokens", F.explode(F.array(*choices)).alias("s")).select("doc_id", "n_tokens", "s.*")
    each = each.withColumn("whole", F.when(F.col("n_tokens") > F.col("capacity"), F.expr("n_tokens div capacity")).otherwise(F.lit(0)).cast("bigint"))
    each = each.withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity")).withColumn("unit", F.ceil(F.col("rest") / F.col("grain")).cast("int"))
    counted = each.groupBy("container", "unit").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).collect()
    # a group may be most of the rows; no task numbers more than about two million of them
    buckets = max(16, sum(r["n"] for r in counted) // 2_000_000)
    plans: dict[str, Plan] = {}
    for name, capacity in capacities:
        grain = -(-capacity // UNITS)
        histogram = np.zeros(capacity // grain + 2, np.int64)
        full = capacity // grain
        for r in counted:
            if r["container"] == str(name) and r["unit"] > 0:
                histogram[min(r["unit"], full)] += r["n"]
        plans[str(name)] = plan_containers(histogram[: full + 1], full)
    rests = group_rank(
        each.filter("rest > 0").withColumn("unit", F.least(F.col("unit"), F.expr("cast(capacity div grain as int)"))),
        ["container", "unit"], ["doc_id"], buckets, "rank",
    ).select("container", "unit", "rank", "doc_id", "whole", "capacity", "rest")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            unit, rank = b.column(1).to_numpy(), b.column(2).to_numpy()
            number = np.zeros(len(unit), np.int64)
            for name in set(names):
                plan, own = plans[name], names == name
                for u in np.unique(unit[own]):
                    here = np.flatnonzero(own & (unit == u))
                    lo, take, base = plan.lo[u], plan.take[u], plan.base[u]
                    at = np.searchsorted(lo, rank[here], "right") - 1
                    number[here] = base[at] + (rank[here] - lo[at]) // take[at]
            whole, capacity = b.column(4), b.column(5)
            start = pa.array(whole.to_numpy() * capacity.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(number), b.column(3), whole, start, b.column(6)],
                names=["container", "container_no", "doc_id", "piece", "token_start", "token_count"],
            )

    packed = rests.mapInArrow(assign, "container string, container_no bigint, doc_id bigint, piece bigint, token_start bigint, token_count bigint")
    # full pieces take containers of their own, numbered behind the packed ones
    after = F.create_map(*[x for n, _ in capacities for x in (F.lit(str(n)), F.lit(plans[str(n)].containers).cast("bigint"))])
    cut = running_total(each.filter("whole > 0"), ["container"], F.col("whole"), ["doc_id"], buckets, "before")
    pieces = cut.select(
        "container", "doc_id", "capacity", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece")
    ).select(
        "container", (after[F.col("container")] + F.col("before") + F.col("piece")).alias("container_no"), "doc_id", "piece",
        (F.col("piece") * F.col("capacity")).alias("token_start"), F.col("capacity").alias("token_count"),
    )
    return packed.unionByName(pieces)


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The container table: a handful of rows by definition; null or non-positive capacities are left out."""
    rows = table(spark, sf_dir, "container_sizes", "container", "capacity_tokens").filter("capacity_tokens > 0").distinct().orderBy("container").collect()
    return [(r[0], r[1]) for r in rows]


def document_sizes(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens`` of every document, exactly, written once."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("doc_id is not null")
    return settle(token_counts(docs, "text", ["doc_id"], tokenizer), "sizes")


# ---------------------------------------------------------------- queries


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each size."""
    return fill_containers(document_sizes(spark, sf_dir), _capacities(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, tokens held and the share of room used, by container size."""
    sizes = table(spark, sf_dir, "container_sizes", "container", "capacity_tokens")
    placed = p7_containers(spark, sf_dir).groupBy("container", "container_no").agg(F.sum("token_count").alias("t"), F.count(F.lit(1)).alias("n"))
    placed = placed.groupBy("container").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("pieces"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return placed.join(sizes, "container").withColumn("used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By container size: documents placed, whether each comes whole and in order, containers over their capacity, whether there are at most a hundredth, and one, more than the tokens need."""
    sizes = document_sizes(spark, sf_dir)
    capacities = _capacities(spark, sf_dir)
    placed = settle(fill_containers(sizes, capacities), "placed")
    w = F.struct("token_start", "token_count")
    pieces = F.array_sort(F.collect_list(w))
    # pieces follow each other without gap and all but the last fill a container
    ends = F.transform("p", lambda x: x["token_start"] + x["token_count"])
    whole = F.forall(F.sequence(F.lit(1), F.size("p")), lambda i: F.when(i == 1, F.element_at("p", 1)["token_start"] == 0).otherwise(F.element_at("p", i)["token_start"] == F.try_element_at(ends, i - 1)))
    each = placed.groupBy("container", "doc_id").agg(pieces.alias("p")).join(sizes, "doc_id").select("container", (whole & (F.element_at(ends, -1) == F.col("n_tokens"))).alias("whole"))
    each = each.groupBy("container").agg(F.count(F.lit(1)).alias("documents"), F.every("whole").alias("whole"))
    room = spark.createDataFrame([(str(n), int(c)) for n, c in capacities], "container string, capacity long")
    filled = placed.groupBy("container", "container_no").agg(F.sum("token_count").alias("t")).join(room, "container")
    filled = filled.groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"), (F.count(F.lit(1)) <= F.ceil(1.01 * F.sum("t") / F.max("capacity")) + 1).alias("filled"))
    return each.join(filled, "container").select("container", "documents", "whole", "overfull", "filled")


P7_INVARIANTS_SQL = """
SELECT container, (SELECT count(DISTINCT doc_id) FROM documents WHERE length(text) > 0) AS documents, true AS whole, 0::BIGINT AS overfull, true AS filled
FROM (SELECT DISTINCT container FROM container_sizes WHERE capacity_tokens > 0)"""
