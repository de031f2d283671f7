"""Op 4 by way of its stored media column and PCM blocks."""

import glob
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilespark.llm import common, flac
from tilespark.llm.queries import QUERIES

TEXTS = [(1, None), (2, ""), (3, "é ß 漢字 🙂"), (4, "word " * 9000), (5, "same"), (5, "same"), (5, "other " * 1000), (None, "lost"), (None, "lost"), (6, "x" * 2048)]


@pytest.fixture()
def docs(spark, tmp_path):
    spark.createDataFrame([(i, t, "more") for i, t in TEXTS], "doc_id long, text string, n_bytes string").write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_query_stores_media_and_blocks(spark, docs, tmp_path):
    found = lambda name: set(glob.glob(f"{common.shared_dir(spark)}/{name}-*"))
    before = found("media") | found("pcm-blocks")
    got = QUERIES["op4_flac"](spark, str(tmp_path))
    want = flac.read_media(flac.text_media(docs))
    assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect()) and got.count() == len(TEXTS)
    new = sorted((found("media") | found("pcm-blocks")) - before)
    media, blocks = (next(f for f in new if f"/{n}-" in f and "payloads" not in f) for n in ("media", "pcm-blocks"))
    streams = {r["media_sha256"]: bytes(r["media"]) for r in spark.read.parquet(media).select("media", F.sha2("media", 256).alias("media_sha256")).collect()}
    rows = spark.read.parquet(blocks).collect()
    assert max(r["block"] for r in rows) == 45_000 // flac.BLOCK and len({r["row"] for r in rows}) == len(TEXTS)
    for r in rows:  # each block stands where its sample offset says
        assert flac.read_samples(streams[r["media_sha256"]], r["sample_offset"], r["n"]) == bytes(r["pcm"])


def test_payloads_of_scattered_blocks(spark, docs):
    media = flac.text_media(docs)
    blocks = common.stored(flac.pcm_blocks(media), "scattered").repartition(7)
    assert Counter(flac.payloads(blocks).collect()) == Counter(flac.read_media(media).collect())
    with pytest.raises(Exception, match="blocks are missing"):
        flac.payloads(blocks.where("not (doc_id = 4 and block = 3)")).collect()


def test_no_documents(spark, docs):
    assert flac.through_store(docs.where("false")).count() == 0


def test_waves_give_the_same(spark, docs):
    once = Counter(flac.through_store(docs).collect())
    assert Counter(flac.through_store(docs, waves=3, one_wave_bytes=0).collect()) == once


def test_every_column_against_a_plain_computation(spark, docs):
    """Streams are decoded by the format's own rules elsewhere; here sizes, digests and checksums by hand."""
    import hashlib
    import zlib

    streams = {(r["doc_id"], r["n_bytes"], hashlib.sha256(bytes(r["media"])).hexdigest()): bytes(r["media"]) for r in flac.text_media(docs).collect()}
    got = flac.through_store(docs).collect()
    for r in got:
        raw = streams[r["doc_id"], r["n_bytes"], r["media_sha256"]]
        (text,) = {(t or "").encode() for i, t in TEXTS if i == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]}
        own = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"]) == (len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(raw))
        x = [v - 128 for v in own]
        steps = [abs(b - a) for a, b in zip(x, x[1:])]
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r["feature"] == f"mean={sum(x) / len(x):.4f};rms={(sum(v * v for v in x) / len(x)) ** 0.5:.4f};peak={max(map(abs, x))};crossings={crossings};step={sum(steps) / len(steps):.4f}"
