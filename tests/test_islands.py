"""Gaps and islands over all tasks against the plain loop."""

import random

import numpy as np
import pytest

from tilespark.sources.ranges import islands, merge, merge_ranges


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 7), (3, 13)])
def test_merged_ranges_equal_a_loop(spark, seed, parts):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(4000) * 10, rng.choice([1, 5, 40, 40, 900 if seed > 1 else 3])) for _ in range(500)]
    rows += [("a", 5, 30_000)] * (seed == 2) + [("c", 1, None), ("c", None, 1)]
    want = {(p, *r) for p in ("a", "b", None) for r in merge([(o, n) for q, o, n in rows if q == p and o is not None and n is not None], 25)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = merge_ranges(spark.createDataFrame(rows, "path string, offset long, length long"), 25).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_ranges(spark):
    assert merge_ranges(spark.createDataFrame([], "path string, offset long, length long")).count() == 0


def test_islands_of_huge_offsets():
    group, at = np.array([0, 0, 1, 1]), np.array([0, 2**61, 0, 2**61])
    begin, ends = islands(group, at, at + 2, 10)
    assert begin.tolist() == [0, 1, 2, 3] and ends.tolist() == [2, 2**61 + 2] * 2
