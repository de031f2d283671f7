"""Scores of the classifiers against plain loops over words and n-grams, and how samples are drawn."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tilespark.llm import common, langid, toxicity
from tilespark.llm.textvec import Hasher, U

WORD = re.compile(rb"[a-z\x80-\xff]+")


def spoken(rng, n):
    return " ".join("".join(rng.choice(["la", "mi", "Ro", "é", "st", "n"]) for _ in range(rng.randint(1, 5))) for _ in range(n))


def texts(seed):
    rng = random.Random(seed)
    return ["", "123 !", "é", *(spoken(rng, rng.randint(1, 40)) + rng.choice([".", " 7", ""]) for _ in range(30))]


def whole_hash(raw):
    """The hash of a run of bytes that stands alone."""
    return int(Hasher(np.frombuffer(raw, np.uint8)).spans(np.array([0]), np.array([len(raw)]))[0])


def test_language_scores_equal_a_plain_loop():
    rng = random.Random(1)
    given = [spoken(rng, 20) + x for x in (" alpha", " beta", " gamma") * 30]
    m = langid.train(given, ["a", "b", "c"] * 30, langid.Settings(buckets=1 << 10))
    data, offs = langid.encode(texts(2))
    got = m.logits(data, offs)
    mask, mul = len(m.table) - 1, 0x9E3779B97F4A7C15
    for t, row in zip(texts(2), got, strict=True):
        buckets = []
        for w in WORD.findall(t.encode().lower()):
            buckets.append(whole_hash(w) & mask)
            for n in m.orders:
                for i in range(len(w) - n + 1):
                    h = whole_hash(w[i : i + n])
                    buckets.append(((h ^ n * 0x9E3779B1) * mul % (1 << 64)) >> 20 & mask)
        mean = np.mean([m.table[b].astype(float) for b in buckets], axis=0) if buckets else np.zeros(3)
        assert np.allclose(row, mean + m.bias, atol=1e-5), t
    langs, score, rejected = m.predict(data, offs)
    z = np.exp(got / m.temperature - (got / m.temperature).max(1, keepdims=True))
    z /= z.sum(1, keepdims=True)
    for k, t in enumerate(texts(2)):
        letters = any(c.isalpha() for c in t)
        assert langs[k] == (m.langs[int(z[k].argmax())] if letters else "und") and abs(score[k] - (z[k].max() if letters else 0)) < 1e-6
        assert rejected[k] == (score[k] < m.threshold)


def test_toxicity_scores_equal_a_plain_convolution():
    rng = random.Random(3)
    given = [spoken(rng, 15) + (" idiot clown" if k % 3 == 0 else "") for k in range(300)]
    s = toxicity.Settings(buckets=1 << 10)
    m = toxicity.train(given, [int(k % 3 == 0) for k in range(300)], None, s)
    data, offs = langid.encode([*texts(4), *given[:20]])
    got = m.raw(data, offs)
    for t, z in zip([*texts(4), *given[:20]], got, strict=True):
        x = []
        for w in WORD.findall(t.encode().lower()):
            e = m.table[whole_hash(w) & (s.buckets - 1) | 1].astype(float)
            for n in s.beginnings:
                if len(w) >= n:
                    e = e + m.table[(whole_hash(w[:n]) * (2 * n + 1) % (1 << 64)) >> (64 - s.buckets.bit_length() + 1)]
            x.append(e)
        top = []
        for kernel, shift in zip(m.kernels, m.shifts, strict=True):
            for f in range(kernel.shape[2]):
                found = [sum(x[i + j] @ kernel[j][:, f] for j in range(len(kernel)) if i + j < len(x)) + shift[f] for i in range(len(x))]
                top.append(max([0.0, *found]))
        assert abs(np.dot(top, m.out) + m.bias - z) < 1e-3, t


def test_thresholds_shrink_to_the_general_one():
    """A language with few calibration texts stays near the threshold of all."""
    rng = random.Random(5)
    given = [spoken(rng, 15) + (" idiot" if k % 2 else "") for k in range(400)]
    reader = langid.train(["xa yb zc " * 4] * 6 + [t for t in given[:60]], ["rare"] * 6 + ["common"] * 60, langid.Settings(orders=(), buckets=1 << 12))
    m = toxicity.train(given, [k % 2 for k in range(400)], reader, toxicity.Settings(buckets=1 << 10))
    assert m.reader.langs == ["common", "rare"] and np.isfinite(m.thresholds).all()


def test_samples_of_any_number_of_languages(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 1200)).alias("lang"))
    got = common.sample_ids(docs, 2, "lang").groupBy("lang").count().collect()
    assert len(got) == 1201 and all(r["count"] == 2 for r in got)
    again = common.sample_ids(docs.repartition(7), 2, "lang").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, common.sample_ids(docs, 2, "lang").collect()))
    assert U is not None


def test_workers_drop_tables_of_other_operators(spark):
    """What a function does to the module's tables happens in the worker's module, not in a copy."""
    import pyarrow as pa

    def build(batches):
        common.worker_tables["one"] = lambda: None
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.worker_tables)] * b.num_rows)], names=["n"])

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common.worker_tables)] * b.num_rows)], names=["n"])

    rows = spark.range(40).repartition(4)
    assert {r["n"] for r in rows.mapInArrow(common.frugal(build, "one"), "n long").collect()} == {1}
    assert {r["n"] for r in rows.mapInArrow(common.frugal(look, "one"), "n long").collect()} <= {0, 1}
    assert {r["n"] for r in rows.mapInArrow(common.frugal(look, "two"), "n long").collect()} == {0}


def test_training_takes_place_in_a_task(spark):
    """The model is the one of the same rows at hand, however they are dealt; without rows it is that of none."""
    rows = spark.range(50).select("id", F.col("id").cast("string").alias("text"))

    def add(table):
        return os.getpid(), table.num_rows, sum(table.column("id").to_pylist())

    for dealt in (rows.repartition(7), rows):
        pid, n, total = common.fitted(dealt, add)
        assert pid != os.getpid() and (n, total) == (50, 1225)
    assert common.fitted(rows.where("id < 0"), add)[1:] == (0, 0)


def test_very_long_texts_are_learned_whole():
    """What is only at the end of a long text is learned from the whole text; its example has one number a bucket at most."""
    s = langid.Settings(buckets=1 << 10)
    long = "ma " * 300_000 + "tail " * 100_000
    buckets, shares = langid.examples([long, ""], s)[0]
    assert len(buckets) == len(s.windows) + 1 and len(buckets[-1]) <= s.buckets and abs(shares[-1].sum() - 1) < 1e-4
    end = whole_hash(b"tail") & (s.buckets - 1)
    assert end in buckets[-1] and all(len(b) == 0 for b in langid.examples([""], s)[0][0])
    model = langid.train([long, "ma " * 5] * 5, ["x", "y"] * 5, s)
    assert model.predict(*langid.encode(["tail tail"]))[0] == ["x"]
