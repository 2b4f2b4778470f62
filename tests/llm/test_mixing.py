"""Permutations, quotas, draws, and the invariants of a mixture."""

from collections import Counter

import numpy as np
import pytest

from pagewright.llm import mixing as M


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000, 4097])
def test_permutations(n):
    a, b = (M.permute(np.arange(n), n, k) for k in (1, 2))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 60 or (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.3


def test_quotas_keep_shares_and_repeats():
    sizes = {"big": 100_000, "small": 3_000, "none": 0}
    q = M.quotas(sizes, [("big", 0.5, 1), ("small", 0.3, 4), ("none", 0.2, 4)], 100)
    assert set(q) == {"big", "small"}
    for s, r in (("big", 1), ("small", 4)):
        assert q[s][1] <= r * q[s][0]
    assert abs(q["big"][1] / (q["big"][1] + q["small"][1]) - 0.625) < 0.01 and q["small"][1] == 120
    assert M.quotas({}, [("a", 1.0, 1)], 100) == {}


@pytest.mark.parametrize("groups", [1, 7])
def test_draws_add_up(groups):
    want, rows = [1003, 77, 0], []
    for g in range(groups):
        rows += list(M.draw_shards(*M.group_counts(want, g, groups), 100, g * 17, 1))
    assert len({k for k, _, _ in rows}) == len(rows) and all(50 <= n.sum() <= 100 for _, _, n in rows)
    for i, total in enumerate(want):
        slots = [s for _, first, n in rows for s in range(first[i], first[i] + n[i])]
        assert slots == list(range(total))


TARGETS = [("hot", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.06, 5), ("nowhere", 0.04, 3)]


def sizes():
    rng = np.random.default_rng(1)
    rows = [(i, "hot", int(n)) for i, n in enumerate(rng.integers(1, 900, 3000))] + [(10_000 + i, "mid", int(n)) for i, n in enumerate(rng.integers(1, 900, 900))]
    return rows + [(20_000 + i, "tiny", 200) for i in range(150)] + [(30_000, "untargeted", 500)]


def test_mixture(spark):
    rows = sizes()
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:20]] + [(40_000, "hot", 0, "x"), (40_001, "hot", None, "x")], "doc_id long, source string, n_tokens long, block string")
    got = M.mix(df, TARGETS, block=64, shard_slots=256).collect()
    length = {r[0]: r[2] for r in rows}
    # a slot holds at most a block; no position is taken twice; shards are of equal size within a group
    slot = Counter()
    for r in got:
        slot[r.shard, r.position] += r.token_count
        assert 0 <= r.token_start and r.token_start + r.token_count <= length[r.doc_id] and r.token_count > 0
    assert max(slot.values()) <= 64
    per_shard = Counter(k for k, _ in slot)
    assert 200 < min(per_shard.values()) <= max(per_shard.values()) <= 256 and all({p for s, p in slot if s == k} == set(range(n)) for k, n in per_shard.items())
    # no token of a document comes more often than its source may repeat
    most = {"hot": 1, "mid": 2, "tiny": 5}
    tokens, total = Counter(), Counter()
    for r in got:
        total[r.source] += r.token_count
        for t in range(r.token_start, r.token_start + r.token_count, 16):
            tokens[r.source, r.doc_id, r.token_start] += 1
            break
    assert all(n <= most[s] for (s, _, _), n in tokens.items())
    everything = sum(total.values())
    for s, share in (("hot", 0.6), ("mid", 0.3), ("tiny", 0.06)):
        assert abs(total[s] / everything - share / 0.96) < 0.01
    assert "untargeted" not in total and "nowhere" not in total
    again = M.mix(df.repartition(7), TARGETS, block=64, shard_slots=256).collect()
    assert sorted(got) == sorted(again)


def test_report(spark, small):
    rows = {r.source: r for r in M.p8_shares(spark, small).collect()}
    assert len(rows) == 12 and all(r.most_repeats <= r.max_repeats for r in rows.values())
    have = [r for r in rows.values() if r.tokens]
    total = sum(r.target_share for r in have)
    assert abs(sum(r.actual_share for r in have) - 1) < 1e-9 and all(abs(r.actual_share - r.target_share / total) < 0.02 for r in have)


def test_nothing_to_mix(spark, tables):
    d = tables(documents=spark.createDataFrame([], "doc_id long, source string, text string"), mix_targets=spark.createDataFrame([("a", 1.0, 2), (None, None, None)], "source string, target_share double, max_repeats int"))
    assert M.p8_mixture(spark, d).count() == 0 and {r.tokens for r in M.p8_shares(spark, d).collect()} == {0}
