"""Operators that must hold for hot groups: ranks, running totals, pairs, components."""

import random
from itertools import combinations

import pytest
from pagewright.operators import components
from pagewright.operators.components import connected_components
from pagewright.operators.pairs import pairs_across, pairs_within
from pagewright.operators.ranks import group_rank, running_total
from pyspark.sql import functions as F


def test_group_rank_is_dense(spark):
    rows = [("hot", i) for i in range(500)] + [("cold", i) for i in range(7)] + [("one", 1)]
    got = group_rank(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], 8, "r").collect()
    for g, n in (("hot", 500), ("cold", 7), ("one", 1)):
        assert sorted(r.r for r in got if r.g == g) == list(range(n))


def test_running_total_covers_without_gaps(spark):
    rng = random.Random(1)
    rows = [("g", i, rng.randint(0, 9)) for i in range(300)]
    got = sorted((r.before, r.v) for r in running_total(spark.createDataFrame(rows, "g string, i int, v int"), ["g"], F.col("v"), ["i"], 8, "before").collect())
    at = 0
    for before, v in got:
        assert before == at
        at += v


def brute_pairs(rows, ok):
    return {(min(a[1], b[1]), max(a[1], b[1])) for a, b in combinations(set(rows), 2) if a[0] == b[0] is not None and a[1] != b[1] and ok(a, b)}


def test_pairs_agree_with_all_pairs(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", i, rng.choice("abc")) for i in range(150)]
    dirty = rows + rows[:20] + [(None, 900, "a"), ("hot", None, "a"), ("hot", 901, None)]
    df = spark.createDataFrame(dirty, "k string, i long, s string").withColumn("n", F.concat(F.lit("n"), "i"))
    got = pairs_across(df, "k", "i", "s", block=8, extra=("n",)).collect()
    assert {(r.i_a, r.i_b) for r in got} == brute_pairs(rows, lambda a, b: a[2] != b[2]) and len(got) == len({(r.k, r.i_a, r.i_b) for r in got})
    assert all(r.n_a == f"n{r.i_a}" and r.n_b == f"n{r.i_b}" for r in got)
    within = pairs_within(df, "k", "i", "s", block=8).collect()
    assert {(r.i_a, r.i_b) for r in within} == brute_pairs(rows, lambda a, b: a[2] != b[2]) and len(within) == len(set(within))


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "k string, i long, s string")
    assert pairs_across(empty, "k", "i", "s").count() == 0 and pairs_within(empty, "k", "i", "s").count() == 0


def brute_components(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by = {}
    for n, e in links:
        find(n)
        if e is not None:
            by.setdefault(e, []).append(n)
    for ns in by.values():
        for n in ns[1:]:
            a, b = sorted((find(ns[0]), find(n)))
            parent[b] = a
    return {n: find(n) for n in parent}


@pytest.mark.parametrize("hot", [10_000, 10])
def test_components_agree_with_union_find(spark, monkeypatch, hot):
    # with the lower threshold the nodes of many edges are joined by broadcast
    monkeypatch.setattr(components, "HOT_LEAST", hot)
    monkeypatch.setattr(components, "HOT_ONE_OF", 100)
    rng = random.Random(3)
    links = [(rng.randint(0, 199), f"e{rng.randint(0, 120)}") for _ in range(220)] + [(n, "hot") for n in range(0, 60, 2)] + [(500, None), (501, "alone")]
    links += [(1000 + i, f"chain{i}") for i in range(40)] + [(1001 + i, f"chain{i}") for i in range(40)]
    df = spark.createDataFrame(links + links[:30] + [(None, "hot")], "node long, entity string")
    assert {r.node: r.component for r in connected_components(df, salts=4).collect()} == brute_components(links)
    assert connected_components(df.limit(0)).count() == 0


def test_a_hot_entity_is_spread(spark):
    """Half of all rows name one entity; no task of the pair join holds more than a few blocks of it."""
    rows = [(i, "hot" if i % 2 else f"k{i % 40}", "ab"[i % 4 // 2]) for i in range(6000)]
    df = spark.createDataFrame(rows, "i long, k string, s string")
    assert {r.component for r in connected_components(df.selectExpr("i AS node", "k AS entity").filter("k = 'hot'").selectExpr("node", "entity")).collect()} == {1}
    pairs = pairs_across(df.filter("k = 'hot'"), "k", "i", "s", block=64).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in pairs) == 1500 * 1500 and len(pairs) > 1 and max(r["count"] for r in pairs) < 0.8 * 1500 * 1500
