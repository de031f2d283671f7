"""Ids of the store's encoder against the library on random texts, and stores that were tampered with."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tilespark.llm import common, tokenstore
from tilespark.llm.queries import tokenizer

LETTERS = "abeit 's'll'S \n\n\t  .,,.!?éÉß漢🙂\u00a0\u2009\u200b12²Ⅷ\x1c\x85\x00ñn\u0303'reZZZİIıK<>|&«»—-_ſﬁÅÅ÷×ÿŸ"


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 80))) for _ in range(2500)]
    words = ["Don't", "we'll", "naïve", "co-op", "3.14", "a,b", "e.g.", "<|endoftext|>", "<|startoftext|>x", "ÉCOLE", "İstanbul", "ﬁn", "x.", "(y)", "z's!"]
    return out + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(800)] + ["a" * 3000, "=-" * 700]


@pytest.fixture(scope="module")
def content():
    pytest.importorskip("public_tokenizers")
    with open(tokenizer("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def test_ids_equal_the_library(content):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_str(content)
    enc = tokenstore.LibraryEncoder(content)
    assert enc.by_word
    given = texts()
    for lo in range(0, len(given), 300):
        part = given[lo : lo + 300]
        ids, at = enc.encode_batch([t.encode() for t in part])
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("change", [{"normalizer": None}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}])
def test_other_files_go_through_the_library(content, change):
    """A file with other steps isn't taken apart."""
    other = json.dumps(json.loads(content) | change)
    lib = pytest.importorskip("tokenizers").Tokenizer.from_str(other)
    enc = tokenstore.LibraryEncoder(other)
    assert not enc.by_word
    part = [t for t in texts()[::40]]
    ids, at = enc.encode_batch([t.encode() for t in part])
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(part))] == [lib.encode(t, add_special_tokens=False).ids for t in part]


SCHEMA = "doc_id long, text string, start int, digests string"


@pytest.mark.parametrize("table,change,says", [
    ("recipes", lambda t: t.withColumn("doc_id", F.when(F.col("doc_id") == 3, 77).otherwise(F.col("doc_id")).cast("long")), "manifest"),
    ("recipes", lambda t: t.withColumn("start", F.col("start") + 1), "manifest"),
    ("recipes", lambda t: t.where("doc_id <> 3"), "manifest"),
    ("manifest", lambda t: t.withColumn("tokens", F.col("tokens") + 1), "manifest"),
    ("both", lambda t: t.where("part <> 0"), "top root"),
    ("chunks", lambda t: t.limit(0), "missing"),
])
def test_tampering_raises(spark, tmp_path, table, change, says):
    at = str(tmp_path / "s")
    tokenstore.write(spark.createDataFrame([(i, f"text number {i} " * 50, 0, "") for i in range(8)], SCHEMA).repartition(3), at, tokenizer("word_bpe_49k.json"))
    assert tokenstore.read_back(spark, at).count() == 8
    for name in ("recipes", "manifest") if table == "both" else (table,):
        change(spark.read.parquet(f"{at}/{name}")).write.parquet(f"{at}/changed-{name}")
        common.remove(spark, f"{at}/{name}")
        spark.read.parquet(f"{at}/changed-{name}").write.parquet(f"{at}/{name}")
    with pytest.raises(Exception, match=says):
        tokenstore.read_back(spark, at).collect()
