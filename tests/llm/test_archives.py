"""WARC archives: round trips with magic in payloads across file blocks, repeats, nulls, and damage."""

import base64
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tilespark.llm import warc

SCHEMA = "page_id long, url string, html string, type string, file int"


def brute(rows, least=0):
    body = [(p, (h or "").encode()) for p, _, h in rows]
    key = lambda p: (p is not None, p or 0)
    top, first = {}, {}
    for p, b in body:
        if b not in top or key(p) > key(top[b]):
            top[b] = p
    out = []
    for p, b in body:
        d = base64.b32encode(hashlib.sha1(b).digest()).decode()
        again = len(b) >= least and not (p == top[b] and first.setdefault(b, len(out)) == len(out))
        out.append((p, len(b), d, "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=repr)


def inner() -> str:
    return "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9:x>\r\nContent-Length: 4\r\n\r\nfour\r\n\r\n"


def hostile(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    bits = ["WARC/1.", "WARC/1.1\r\n", inner(), "x" * 300, "é\r\n\r\n", "WARC/", "\r\n\r\n", "WWARC/1.0\r\nA: b\r\nContent-Length: 100000\r\n\r\n", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "WARC/1.1\r\nContent-Length: 99999999999999999999\r\n\r\n"]
    rows = [(i if i % 17 else None, f"http://a/{i}\r\nContent-Length: 3" if i % 5 else None, None if i % 11 == 0 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 5, 30])))) for i in range(-10, 90)]
    return rows + rows[:20]


@pytest.mark.parametrize(("seed", "size"), [(1, "700b"), (2, "5000b"), (3, "128m")])
def test_magic_inside_payloads(spark, tmp_path, seed, size):
    rows = hostile(seed)
    warc.write(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3), str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = sorted((tuple(r) for r in warc.read_back(spark, str(tmp_path / "w")).collect()), key=repr)
        assert got == brute(rows)
        full = warc.records(spark, str(tmp_path / "w"), payloads=True).where("type = 'response'").select("payload").collect()
        assert sorted(bytes(r[0]) for r in full) == sorted({(h or "").encode() for _, _, h in rows})
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(i, "u", h) for i, h in enumerate(["aa", "aa", "bbbb", "bbbb", "bbbb", "", ""])]
    warc.write(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), str(tmp_path / "w"), least=3)
    assert sorted((tuple(r) for r in warc.read_back(spark, str(tmp_path / "w")).collect()), key=repr) == brute(rows, 3)


def test_a_hot_payload_without_broadcasts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, "u", "same" if i % 3 else f"WARC/1.{i % 40}") for i in range(200)]
    warc.write(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), str(tmp_path / "w"))
    assert sorted((tuple(r) for r in warc.read_back(spark, str(tmp_path / "w")).collect()), key=repr) == brute(rows)


def test_empty_table_and_very_long_payload(spark, tmp_path):
    warc.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert warc.read_back(spark, str(tmp_path / "none")).count() == 0
    rows = [(1, "u", "long " * 2_000_000), (2, "u", None)]
    warc.write(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), str(tmp_path / "long"))
    assert sorted((tuple(r) for r in warc.read_back(spark, str(tmp_path / "long")).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("harm", ["cut", "payload", "length"])
def test_damage_raises(spark, tmp_path, harm):
    warc.write(spark.createDataFrame([(i, "u", f"page {i}", "x", 1) for i in range(6)], SCHEMA).coalesce(1), str(tmp_path / "w"))
    at = next(f for f in glob.glob(str(tmp_path / "w" / "part-*")) if b"WARC" in open(f, "rb").read())
    raw = open(at, "rb").read()
    worse = {"cut": raw[:-9], "payload": raw.replace(b"page 3", b"page 4"), "length": raw.replace(b"Content-Length: 84", b"Content-Length: 83", 1)}[harm]
    assert worse != raw
    open(str(tmp_path / "worse.txt"), "wb").write(worse)
    with pytest.raises(ValueError):
        warc.read_back(spark, str(tmp_path / "worse.txt")).count()


def test_base32(spark):
    got = spark.range(50).select(F.col("id").cast("string").alias("s")).select("s", warc.base32(F.sha1(F.col("s").cast("binary"))).alias("b")).collect()
    assert all(r["b"] == base64.b32encode(hashlib.sha1(r["s"].encode()).digest()).decode() for r in got)


def test_forest():
    leave, tin, tout, parent = warc.forest([0, 10, 12, 20, 30], [10, 20, 17, 40, 30 + 99], 40)
    assert leave == [40, 40, None, 40, 129] and parent == [1, 3, None, None, None]
    on = lambda e: [i for i in range(5) if tin[i] <= tin[e] < tout[i]]
    assert on(0) == [0, 1, 3] and on(2) == [2] and on(4) == [4] and on(1) == [1, 3]
