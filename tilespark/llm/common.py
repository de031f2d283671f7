"""Shared pieces: the shared working folder, bounded training samples, Arrow text buffers and
connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

#: Upper and lower case of the ASCII letters, for lower-casing that leaves all other letters alone.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, as in tests, may do
    without: there it is a new local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark.sparkContext, "_tilespark_shared", None) or tempfile.mkdtemp(prefix="tilespark-")
        spark.sparkContext._tilespark_shared = at
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again, so that a lost
    executor costs no recomputation of what lies before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `stored` wrote, once nothing reads them any more."""
    for t in tables:
        for f in {os.path.dirname(f) for f in t.inputFiles()}:
            remove(t.sparkSession, f)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Whole texts are large rows: fewer of them go to Python at once than the defaults of 10,000 rows and 64 MB.
    This lowers the session's settings, as plans read them when they run; smaller ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.sub(r"\D", "", spark.conf.get(key))
        if not 0 < int(now or 0) <= most:
            spark.conf.set(key, str(most))


#: Tables that a Python worker has built for an operator, by the operator's name, and how to drop them.
worker_tables: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Returns freed memory of this Python process to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_other_tables(name: str) -> None:
    """In a worker: only the tables of the operator of this name stay."""
    for other in [k for k in worker_tables if k != name]:
        worker_tables.pop(other)()


def frugal(work, name: str = ""):
    """The function of a mapInArrow, for Python workers that live through all stages of a job: tables of
    operators with another name are dropped when it begins, and memory is given back when its partition ends."""

    @functools.wraps(work)
    def run(batches):
        drop_other_tables(name)
        yield from work(batches)
        give_back()

    return run


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. Texts of ASCII alone take the faster built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_ids(df: DataFrame, n: int, by: str | None = None) -> DataFrame:
    """At most n ids of df (columns doc_id and by), or n for each value of `by`, however many values there
    are, in the order of a seeded hash. Narrow rows only. Rows of each value are ranked in 64 parts, the first n
    of these in 8, and those at last together, so a value with a third of all rows burdens no task."""
    key = F.xxhash64("doc_id", F.lit(7))
    if by is None:
        return df.orderBy(key, "doc_id").limit(n)
    order = [F.col("_key"), F.col("doc_id")]
    left = df.select("doc_id", by, key.alias("_key"), F.xxhash64("doc_id", F.lit(8)).alias("_part"))
    for parts in (64, 8, 1):
        own = Window.partitionBy(by, F.pmod("_part", F.lit(parts))).orderBy(*order)
        left = left.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= n).drop("_k")
    return left.select("doc_id", by)


def fitted(sample: DataFrame, train: Callable[[pa.Table], Any]) -> Any:
    """What train makes of a bounded sample. Its rows meet in one task, not on the driver, which gets the model alone."""
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in sample.schema])

    def work(batches):
        got = list(batches)
        table = pa.Table.from_batches(got) if got else schema.empty_table()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table))])], names=["model"])

    rows = sample.repartition(1).mapInArrow(frugal(work), "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else train(schema.empty_table())


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, one after another, and where each begins; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    a = pc.fill_null(col.cast(pa.large_binary()), b"")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and len(a) else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunked(data: np.ndarray, offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `limit` bytes: first row, end row, bytes, starts."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


#: Tables of so many rows at most are broadcast, after counting them.
BROADCAST_ROWS = 300_000


#: Edges that a task holds while it contracts its own.
HELD_EDGES = 500_000


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the edges (a, b): every node, and the smallest node that it reaches by them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[two]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while ((up := root[root]) != root).any():
            root = up


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u > v) with the components of `edges` (u, v): each task gives, for runs of HELD_EDGES of its own, an
    edge from every node to the smallest that it reaches there. These are no more than before, and fewer rounds away."""

    def work(batches):
        def run() -> pa.RecordBatch:
            nodes, low = smallest_reached(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[nodes > low]), pa.array(low[nodes > low])], names=["u", "v"])

        held, n = [], 0
        for b in batches:
            held.append([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("u", "v")])
            n += b.num_rows
            if n >= HELD_EDGES:
                yield run()
                held, n = [], 0
        if n:
            yield run()

    return edges.select("u", "v").mapInArrow(frugal(work), "u long, v long")


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b: long) as (node, component), component being the smallest
    node. Tasks contract the edges that they hold, twice with a shuffle between, so that few rounds are left; then
    large-star and small-star steps alternate, each a plan of its own that reads its edges from the shared
    folder. Minima are pre-aggregated; they are broadcast while edges are few, and beyond that the minima of
    hubs are broadcast and their edges stay where they are, so no task meets all edges of a hub. Nodes
    without an edge to another node aren't returned."""

    def beside_minimum(e: DataFrame, most: int) -> DataFrame:
        """The edges (u, v) with the least of u and its neighbours (m)."""
        m = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("m", "u"))
        return e.join(F.broadcast(m), "u") if most <= BROADCAST_ROWS else lookup(e, stored(m, f"{name}-minima"), ["u"], "degree", most)

    def each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
        """(u, v) of each row for each pair of its columns, in one reading of rows."""
        return rows.select(F.explode(F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs))).alias("e")).select("e.u", "e.v")

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    for _ in range(2):
        e = stored(contracted(e).distinct(), name)
    state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = each(e, ("u", "v"), ("v", "u"))
        large = beside_minimum(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = stored(large, f"{name}-large")
        small = each(beside_minimum(large, 2 * state[0]), ("v", "m"), ("u", "m")).where("u > v").distinct()
        e = stored(small, name)
        new = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(new) == tuple(state):
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return each(e, ("u", "v"), ("v", "v")).distinct().toDF("node", "component")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a table that has one row for each value of keys and, in `size`, how
    many rows have it. Values that more than a thousandth of all rows have (fewer than 1000, so they can be
    broadcast) don't shuffle; no other value can burden a task."""
    heavy = table.where(F.col(size) * 1000 > total)
    light = table.where(F.col(size) * 1000 <= total)
    plain = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(plain)
