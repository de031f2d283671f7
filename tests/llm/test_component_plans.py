"""Connected components: what tasks contract, and how large the plans of the rounds are."""

import random

import numpy as np

from tilespark.llm import common


def brute(edges):
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed = changed or root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_smallest_reached():
    for seed in range(20):
        rng = random.Random(seed)
        edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(rng.randrange(1, 90))]
        nodes, low = common.smallest_reached(*np.array(edges, np.int64).T)
        assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == brute(edges)


def test_plans_stay_small(spark, monkeypatch):
    """A step reads each exchange once: one broadcast and few shuffles a plan, and few plans even for a long chain."""
    plans, was = [], common.stored

    def seen(df, name, partitions=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return was(df, name, partitions)

    monkeypatch.setattr(common, "stored", seen)
    chain = [(k, k + 1) for k in range(0, 3000)] + [(k, k + 3) for k in range(5000, 6000, 3)]
    random.Random(5).shuffle(chain)
    edges = spark.createDataFrame(chain, "a long, b long").repartition(7)
    result = common.components(edges)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    got = {r["node"]: r["component"] for r in result.collect()}
    assert got == {**{k: 0 for k in range(3001)}, **{k: 5000 for k in range(5000, 6003, 3)}}
    assert max(p.count("BroadcastExchange") for p in plans) <= 1
    assert max(p.count("Exchange hashpartitioning") for p in plans) <= 2
    assert len(plans) <= 12


def test_no_edges(spark):
    assert common.components(spark.createDataFrame([(4, 4)], "a long, b long")).collect() == []
