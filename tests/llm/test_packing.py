"""Plans, the solver, and the invariants of a filling."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagewright.llm import packing as B


def test_combinations_fill_the_window():
    units = np.array([1, 2, 3, 5, 8])
    got = {tuple(sorted(int(u) for u in row if u)) for row in B.combinations(units, 8, 1)}
    want = {tuple(sorted(c)) for n in (1, 2, 3) for c in __import__("itertools").combinations_with_replacement(units.tolist(), n) if 7 <= sum(c) <= 8}
    assert got == want


def test_solver_finds_an_exact_mixture():
    combos = B.combinations(np.arange(1, 17), 16, 0)
    rng = np.random.default_rng(1)
    true = np.zeros(len(combos))
    true[rng.choice(len(combos), 8, replace=False)] = rng.integers(1, 50, 8)
    h = np.bincount(combos.ravel(), np.repeat(true, 3), 17)
    h[0] = 0
    x = B.solve_nnls(combos, h, 2000)
    used = np.bincount(combos.ravel(), np.repeat(x, 3), 17)
    used[0] = 0
    assert (x >= 0).all() and np.abs(used - h).max() < 0.5


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_item_once(seed):
    rng = np.random.default_rng(seed)
    full = 64
    h = np.zeros(full + 1, np.int64)
    h[1:] = rng.integers(0, 40, full) * (rng.random(full) < 0.6)
    plan = B.plan_containers(h, full)
    load = Counter()
    for u in range(1, full + 1):
        for rank in range(h[u]):
            at = np.searchsorted(plan.lo[u], rank, "right") - 1
            load[int(plan.base[u][at] + (rank - plan.lo[u][at]) // plan.take[u][at])] += u
    assert max(load.values(), default=0) <= full and set(load) == set(range(plan.containers))
    assert plan.containers <= -(-int(h @ np.arange(full + 1)) // full) * 1.15 + 2


def check(rows, sizes, capacities):
    for name, capacity in capacities:
        own = [r for r in rows if r.container == name]
        load, pieces = Counter(), defaultdict(list)
        for r in own:
            load[r.container_no] += r.token_count
            pieces[r.doc_id].append((r.token_start, r.token_count))
        assert max(load.values(), default=0) <= capacity and set(load) == set(range(len(load)))
        assert set(pieces) == set(sizes)
        for doc, parts in pieces.items():
            at = 0
            for start, n in sorted(parts):
                assert start == at and n > 0
                at += n
            assert at == sizes[doc]
            if sizes[doc] <= capacity:
                assert len(parts) == 1
        # no filling needs fewer than the tokens ask for, nor than the pieces that cannot share a container
        large = sum(1 if 2 * r.token_count > capacity else 0.5 for r in own if 2 * r.token_count >= capacity)
        assert len(load) <= 1.03 * max(-(-sum(sizes.values()) // capacity), large) + 2


def test_every_text_is_placed_whole(spark):
    rng = random.Random(2)
    sizes = {i: max(1, int(rng.lognormvariate(4.8, 1.2))) for i in range(3000)} | {i: 256 for i in range(3000, 4500)} | {9001: 512, 9002: 513, 9003: 100_000, 9004: 1}
    rows = list(sizes.items())
    df = spark.createDataFrame([(i, n, "x") for i, n in rows + rows[:50]] + [(9999, 0, "x"), (9998, None, "x")], "doc_id long, n_tokens long, unit string")
    capacities = [("small", 512), ("odd", 1000), ("large", 8192)]
    check(B.fill_containers(df, capacities).collect(), sizes, capacities)


def test_nothing_to_fill(spark, tables):
    d = tables(documents=spark.createDataFrame([], "doc_id long, text string"), container_sizes=spark.createDataFrame([("s", 16), ("bad", 0), ("none", None)], "container string, capacity_tokens long"))
    assert B.p7_containers(spark, d).count() == 0 and B.p7_fill(spark, d).count() == 0


def test_query_places_the_tables(spark, small):
    rows = B.p7_containers(spark, small).collect()
    sizes = {r.doc_id: r.n_tokens for r in B.document_sizes(spark, small).collect() if r.n_tokens}
    check(rows, sizes, [("small", 512), ("medium", 2048), ("large", 8192)])
