"""The join where groups are large: deletions by cost, salted signatures, runs, block pairs and copied texts."""

import random

import numpy as np
import pytest
from test_llm import brute_classes, make

from tilespark.llm import simjoin


def test_cost_decides_on_deletions():
    """In bands of any size: few sets make exact segments cheapest, very many sets with frequent shingles deletions."""
    t = simjoin.Threshold()
    for low, high in ((23, 31), (182, 255), (1449, 2047)):
        assert simjoin.allocate(low, high, t, 0.3, simjoin.crowding(1000)).deletions == 0
        assert simjoin.allocate(low, high, t, 0.6, simjoin.crowding(10**9)).deletions > 0


@pytest.mark.parametrize("n", [30, 200, 600])
def test_linked_sets_meet_through_deletions(n):
    t, rng = simjoin.Threshold(), np.random.default_rng(n)
    made = simjoin.Signatures(t, np.sort(rng.integers(0, 1 << 62, 50).astype(np.uint64)), 0.6, simjoin.crowding(10**9))
    used = False
    for _ in range(60):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        out = int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.r_[a[out:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)])
        a = np.unique(a)
        if t.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            assert len(np.intersect1d(made.of(a), made.of(b)))
            used = used or any(x.deletions for x in made.bands.values())
    assert used


def near_copies(seed):
    """Groups of near copies around shared passages, some a chain in which only neighbours link."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    rows, passage = [], [word() for _ in range(30)]
    for g in range(3):
        w = [word() for _ in range(40)]
        for _ in range(45):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = word()
            if g == 1:
                w = v  # the next one starts from here
            rows.append(v)
    rows += [passage + [word() for _ in range(rng.choice([2, 8, 25]))] for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [0, 1])
def test_large_groups_equal_brute_force(spark, seed, monkeypatch):
    """With all bounds so small that every way of dealing groups is taken."""
    for name, value in (("NEAR", 1), ("REACH", (2,)), ("RUN", 8), ("PAIR_BLOCK", 5), ("MANY_PAIRS", 4), ("CROWD", 3)):
        monkeypatch.setattr(simjoin, name, value)
    rows = near_copies(seed)
    t = simjoin.Threshold(3, 70, 100)
    assert {tuple(r) for r in simjoin.classes(make(spark, rows), t).collect()} == brute_classes(rows, t)


def test_repeated_and_null_ids(spark):
    """Each row is a text of its own; components are named by the smallest id known in them."""
    a = "one two three four five six seven eight nine ten"
    docs = make(spark, [(1, a), (1, "quite another text with words"), (2, a + " eleven"), (None, a), (None, "alone here now again"), (3, "Quite another text with words")])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simjoin.classes(docs, simjoin.Threshold(4, 80, 100)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (None, None), (3, 1)], key=str)
