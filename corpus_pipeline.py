"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing to target weights, BPE.

Each stage takes the documents that its predecessor kept and returns documents, the last one token counts
and digests. Stages are written as Parquet and read again, so a lost executor costs one stage at most.
Mixing takes a document once for each epoch that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import bpe, dedup, mixing, simjoin, toxicity
from tilespark.llm.common import scratch
from tilespark.llm.queries import plan, tokenizer


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simjoin.keep_one(docs, simjoin.Threshold(words=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    aside = {c: f"{c}__in" for c in docs.columns if c.lower() in ("_path", "_tokens", "_epoch")}  # names that give way
    return mixing.mix(docs.withColumnsRenamed(aside), plan()).select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the classifier, so the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
