"""What stays comes from the stream's state; keys that collide are told apart by the bytes."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from tilespark.llm import dedup

SCHEMA = "doc_id long, text string, n int"


def given():
    rng = random.Random(8)
    return [(rng.choice([None, *range(40)]), rng.choice(["", None, "É", "é"] + [f"Text {k}" if k % 2 else f"text {k}" for k in range(60)]), i) for i in range(150)]


def test_colliding_keys(spark):
    rows = given()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").encode().lower()].append(i)
    want = []
    for i, t, _ in rows:
        own = groups[(t or "").encode().lower()]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode().lower()).hexdigest()))
    docs = spark.createDataFrame(rows, SCHEMA)
    key = lambda r: (r[4], -1 if r[0] is None else r[0])
    for key_bytes in (0, 1, 16):  # one key for all, many collisions, none
        assert sorted(map(tuple, dedup.judge(docs, key_bytes=key_bytes).collect()), key=key) == sorted(want, key=key)
        left = dedup.deduplicate(docs, key_bytes=key_bytes).collect()
        assert sorted((r["text"] or "").encode().lower() for r in left) == sorted(groups)


def test_result_is_the_state(spark, monkeypatch):
    """A state that says otherwise shows in the result."""
    real = dedup.run_stream

    def other(stream, path, partitions):
        s = real(stream, path, partitions)
        return s.select("key", F.struct(F.lit(-5).cast("long").alias("doc_id"), F.col("keep.locator").alias("locator")).alias("keep"), (F.col("n") + 10).alias("n"))

    monkeypatch.setattr(dedup, "run_stream", other)
    got = dedup.judge(spark.createDataFrame([(1, "a", 0), (2, "A", 0)], SCHEMA)).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got} == {(-5, 12)}
