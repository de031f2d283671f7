"""Stored slot maps, and the rows of shards against brute force."""

import random
import zlib
from collections import Counter, defaultdict

from tilespark.llm import sharding

SCHEMA = "doc_id long, text string, slot int, shard string"


def rows(n, seed=3):
    rng = random.Random(seed)
    out = [(i, rng.choice([None, "", "é" * rng.randint(0, 50), "x" * rng.randint(0, 300)]), 1, "s") for i in range(n)]
    return out + [(None, "same", 1, "s")] * 200 + [out[1]] * 30 + [(5, "other text of an id", 1, "s")]


def check(given, got, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in given)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    places, load = defaultdict(list), defaultdict(int)
    for r in got:
        places[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert set(places) == set(range(shards)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    return load


def test_rows_of_shards(spark, tmp_path):
    given = rows(4000)
    docs = spark.createDataFrame(given, SCHEMA).repartition(3)
    at = str(tmp_path / "m")
    load = check(given, sharding.shard(docs, 8, map_path=at).collect(), 8)
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8
    more = given + [(100_000 + i, "y" * 500, 1, "s") for i in range(900)]
    grown = spark.createDataFrame(more, SCHEMA)
    before = sharding.SlotMap.load(spark, at)
    got = sharding.shard(grown, 9, map_path=at, grow=True).collect()
    load = check(more, got, 9)
    assert max(load.values()) < 1.1 * sum(load.values()) / 9
    after = sharding.SlotMap.load(spark, at)
    moved = {k for k, (a, b) in enumerate(zip(before.owner, after.owner, strict=True)) if a != b}
    assert (after.version, after.shards) == (1, 9) and moved and moved <= {e[1] for e in after.edits}
    assert all(r["shard"] == after.owner[r["vslot"]] for r in got)  # the edited map is the one in use


def test_maps_come_back_as_they_were(spark, tmp_path):
    at = str(tmp_path / "m")
    m = sharding.SlotMap.planned(list(range(1, 301)), 11)
    m.save(spark, at)
    m.save(spark, at)
    back = sharding.SlotMap.load(spark, at)
    assert (back.owner, back.shards, back.version, back.edits) == (m.owner, 11, 0, [])
    grown = m.rebalance(list(range(1, 301)), 12)
    grown.save(spark, at)
    back = sharding.SlotMap.load(spark, at)
    assert (back.owner, back.shards, back.version, back.edits) == (grown.owner, 12, 1, sorted(grown.edits)) and back.edits
    assert sharding.SlotMap.load(spark, at, 0).owner == m.owner
    empty = sharding.SlotMap.planned([0] * 300, 50)  # more shards than the owners name
    empty.save(spark, str(tmp_path / "e"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "e")).shards == 50
