"""Exact dedup as stateful streaming.

Texts are equal when identical after lower-casing A-Z. A structured stream of digests keeps one state row
for each digest, in RocksDB on the executors' disks and in the checkpoint, without watermark and so without
expiry: the digest's first bytes as key, the identifier of the row that stays (the largest doc_id) with the
locator of its content (file and row), and the number of rows. Rows are pre-aggregated before they reach the
state, so a group with a third of all rows is one row a task. What stays, and how many rows share its text,
comes from the state. Keys that were hit more than once are checked on the full bytes, which are fetched by
locator and pre-aggregated: where two texts share a key, their rows are grouped by the bytes themselves.

Null counts as the empty text. Of rows with equal text the one with the largest doc_id stays, and the last by
file and row of those with this id; null ids stay only where no id is known. An empty table gives an
empty result; other columns don't matter. A restarted stream goes on from its checkpoint: groups that it
has finished aren't counted again. Tables that aren't read from files are first written to the shared folder,
which gives their rows a place.
"""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm.common import BROADCAST_ROWS, ascii_lower, frugal, lookup, remove, scratch, small_batches, stored, text_buffer

#: Bytes of a digest that the state is keyed by.
KEY_BYTES = 16
#: A state store holds about so many rows: stores cost memory even when they hold few.
STORE_ROWS = 500_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for a while; streams copy them when they start."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame, at: str = "_at") -> DataFrame:
    """docs with the place of each row, file and row number, in the column at, which replaces one of this name."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != at.lower()]

    def placed(df: DataFrame) -> DataFrame:
        hidden = df.metadataColumn("_metadata")  # the files', whatever columns there are
        return df.select(*kept, F.concat_ws("#", hidden["file_path"], hidden["row_index"]).alias(at))

    log = logging.getLogger("DataFrameQueryContextLogger")
    quiet, log.disabled = log.disabled, True  # that a table has no files is no error here
    try:
        return placed(docs)
    except AnalysisException:
        return placed(stored(docs, "located-rows"))
    finally:
        log.disabled = quiet


def free_name(name: str, columns: list[str]) -> str:
    """A name like this one that no column has."""
    while any(c.lower() == name.lower() for c in columns):
        name += "_"
    return name


def digests(rows: DataFrame, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, key, sha (SHA-256 of the normalised text), locator, from rows with doc_id, text and _at."""

    def look(batches):
        for b in batches:
            data, offs = text_buffer(b.column("text"))
            raw = memoryview(data.tobytes().lower())
            made = [hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest() for i in range(len(offs) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([x[:key_bytes] for x in made], pa.binary()), pa.array(made, pa.binary()), b.column("_at")], names=["doc_id", "key", "sha", "locator"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "text", "_at").mapInArrow(frugal(look), "doc_id long, key binary, sha binary, locator string")


def keyed_state(stream: DataFrame) -> DataFrame:
    """The streaming state: a row for each key, never expiring."""
    return stream.groupBy("key").agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count("*").alias("n"))


def stores(spark: SparkSession, rows: int) -> int:
    """Stores for so many rows: one a task slot at least, the session's number of shuffle partitions at most."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // STORE_ROWS))))


def run_stream(stream: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Feeds all that the stream has now through the state; returns the state as (key, keep, n). State
    and progress are under path; run again on a stream with more files, it takes only the new ones. partitions:
    how many stores the state is dealt to when it begins."""
    spark = stream.sparkSession

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")  # the same again on a retry

    conf = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        # executors close the stores soon after the stream has ended: later stages need the memory
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
        # many small stores: files that are made large in advance would outweigh the state itself
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    if partitions:
        conf["spark.sql.shuffle.partitions"] = str(partitions)
    with settings(spark, **conf):
        q = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(emit).trigger(availableNow=True).start()
        q.awaitTermination()
    changes = spark.read.schema("key binary, keep struct<doc_id:long,locator:string>, n long, epoch int").parquet(f"{path}/changes")
    # counts only grow, so the largest is the latest
    return changes.groupBy("key").agg(F.max(F.struct("n", "keep")).alias("s")).select("key", F.col("s.keep").alias("keep"), F.col("s.n").alias("n"))


def judged(rows: DataFrame, key_bytes: int, files_at_once: int) -> DataFrame:
    """doc_id, sha, locator of every row, with keep (doc_id and locator of the row that stays) and n where its
    text is hit more than once. rows: doc_id, text, _at."""
    spark = rows.sparkSession
    path = scratch(spark, "dedup")
    digests(rows, key_bytes).write.parquet(f"{path}/log")
    log = spark.read.parquet(f"{path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_at_once).parquet(f"{path}/log")
    n_all = log.count()
    run_stream(stream, f"{path}/stream", stores(spark, n_all)).where("n > 1").write.parquet(f"{path}/hits")
    remove(spark, f"{path}/stream/changes")
    hits = spark.read.parquet(f"{path}/hits")
    n_hits, n_rows = (int(v or 0) for v in hits.agg(F.count("*"), F.sum("n")).first())

    def marked(how: str) -> DataFrame:
        return log.join(F.broadcast(hits), "key", how) if n_hits <= BROADCAST_ROWS else lookup(log, hits, ["key"], "n", n_all, how)

    # the full bytes of every row whose key was hit, by locator
    members = marked("inner").select(F.col("locator").alias("_at"), "key")
    texts = rows.select("doc_id", "_at", ascii_lower(F.coalesce("text", F.lit(""))).alias("norm"))
    texts = texts.join(F.broadcast(members) if n_rows <= BROADCAST_ROWS // 4 else members, "_at")
    exact = texts.groupBy("key", "norm").agg(F.max(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("_at").alias("locator"))).alias("keep"), F.count("*").alias("n"))
    exact.select("key", F.unhex(F.sha2("norm", 256)).alias("sha"), F.sha2(F.concat(F.lit("other"), "norm"), 256).alias("variant"), "keep", "n").write.parquet(f"{path}/exact")
    exact = spark.read.parquet(f"{path}/exact")
    collided = exact.groupBy("key").count().where("count > 1").select("key")
    result = marked("left")
    if not collided.isEmpty():  # equal keys of different bytes: such rows are told apart by their bytes
        apart = stored(collided, "dedup-collided")
        own = texts.join(apart, "key", "left_semi").select(F.col("_at").alias("locator"), F.col("doc_id").cast("long").alias("doc_id"), "key", F.sha2(F.concat(F.lit("other"), "norm"), 256).alias("variant"))
        groups = exact.join(apart, "key", "left_semi")
        own = own.join(groups, ["key", "variant"]).withColumn("hit", F.col("n") > 1)
        own = own.select("doc_id", "sha", "locator", F.when(F.col("hit"), F.col("keep")).alias("keep"), F.when(F.col("hit"), F.col("n")).alias("n"))
        return result.join(apart, "key", "left_anti").select(*own.columns).unionByName(own)
    return result.select("doc_id", "sha", "locator", "keep", "n")


def judge(docs: DataFrame, files_at_once: int = 1000, key_bytes: int = KEY_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = judged(located(docs.select("doc_id", "text")), key_bytes, files_at_once)
    keep = F.when(F.col("n").isNotNull(), F.col("keep.doc_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, files_at_once: int = 1000, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row of each text stays: the one that the state points to. Rows are told by their place, so ids may
    repeat or be null; all columns stay as they are."""
    at = free_name("_at", docs.columns)
    rows = located(docs, at)
    seen = judged(rows.select("doc_id", "text", F.col(at).alias("_at")), key_bytes, files_at_once)
    dropped = stored(seen.where("n is not null and locator <> keep.locator").select(F.col("locator").alias(at)), "dedup-dropped")
    left = rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS // 4 else dropped, at, "left_anti")
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))
