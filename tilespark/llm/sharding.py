"""Sharding by fixed virtual slots.

Records are hashed by their id and text into thousands of slots, once and for all; bytes are summed by slot; and
a table says which shard owns each slot. That table is small and of fixed size (one row a slot), is kept in
versions with the edits that led from one to the next, and rebalancing edits it: only the slots it moves change
shards. A record's place is looked up by its slot, its position within the shard comes from counts of (slot,
part) groups, so no shard ever meets in one task.

A record counts as the UTF-8 bytes of its text (null: none) plus `overhead`, whole texts however long. Null ids are
hashed by their text and their place in the table, so that many of them don't share a slot. Rows that repeat id
and text share a slot and get positions of their own. Shards are near equal in bytes (law `bytes`); equal
texts of different ids aren't kept together, as one text may have more rows than a shard holds. An empty table
gives a map without bytes. Other columns of docs, also ones called slot or shard, don't matter.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import scratch, stored

SLOTS = 8192
#: Rows of a slot are numbered in parts of about so many rows.
PART_ROWS = 50_000


def vslot(doc_id: Column, text_crc32: Column, size: Column, row: Column, slots: int = SLOTS) -> Column:
    """The slot of a record; row, its place in the table, only counts where there is no id."""
    hashed = F.xxhash64(doc_id, text_crc32, size, F.when(doc_id.isNull(), row))
    return F.pmod(hashed, F.lit(slots)).cast("int")


@dataclass
class SlotMap:
    """Which shard owns each slot, with the versions that led there: (version, slot, from, to)."""

    owner: list[int]
    shards: int
    version: int = 0
    edits: list[tuple[int, int, int, int]] = field(default_factory=list)

    @staticmethod
    def planned(sizes: list[int], shards: int) -> SlotMap:
        """Largest slot first, each to the shard with the fewest bytes so far."""
        heap = [(0, s) for s in range(shards)]
        owner = [0] * len(sizes)
        for slot in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            load, s = heapq.heappop(heap)
            owner[slot] = s
            heapq.heappush(heap, (load + sizes[slot], s))
        return SlotMap(owner, shards)

    def loads(self, sizes: list[int]) -> list[int]:
        out = [0] * self.shards
        for slot, s in enumerate(self.owner):
            out[s] += sizes[slot]
        return out

    def rebalance(self, sizes: list[int], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
        """The next version: moves slots from shards above the mean (or beyond the new number of shards)
        to those below it, smallest sufficient slots first, until all are within tolerance of the mean
        or no single move helps. Slots that needn't move stay."""
        n = shards or self.shards
        out = SlotMap(list(self.owner), n, self.version + 1, list(self.edits))
        load = [0] * max(n, self.shards)
        own: list[list[int]] = [[] for _ in load]
        for slot, s in enumerate(self.owner):
            load[s] += sizes[slot]
            own[s].append(slot)
        mean = sum(sizes) / n

        def move(slot: int, a: int, b: int) -> None:
            out.owner[slot] = b
            out.edits.append((out.version, slot, a, b))
            own[a].remove(slot)
            own[b].append(slot)
            load[a] -= sizes[slot]
            load[b] += sizes[slot]

        for a in range(n, len(load)):
            for slot in sorted(own[a], key=lambda k: -sizes[k]):
                move(slot, a, min(range(n), key=lambda s: (load[s], s)))
        for _ in range(2 * len(sizes)):
            a, b = max(range(n), key=lambda s: (load[s], s)), min(range(n), key=lambda s: (load[s], s))
            if load[a] <= mean * (1 + tolerance) and load[b] >= mean * (1 - tolerance):
                break
            want = min(load[a] - mean, mean - load[b])
            fit = [k for k in own[a] if 0 < sizes[k] < load[a] - load[b]]
            if not fit:
                break
            move(min(fit, key=lambda k: (abs(sizes[k] - want), k)), a, b)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, s, self.shards) for k, s in enumerate(self.owner)], "vslot int, shard int, shards int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Stores this version at path: owners of slots, and the edits that made it from the one before. Saving a
        version again replaces it."""
        edits = [e[1:] for e in self.edits if e[0] == self.version]
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/owners/version={self.version}")
        spark.createDataFrame(edits, "vslot int, from int, to int").coalesce(1).write.mode("overwrite").parquet(f"{path}/edits/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, the latest one if none is given, with all edits up to it."""
        t = spark.read.schema("vslot int, shard int, shards int, version int").parquet(f"{path}/owners")
        if version is None:
            version = t.agg(F.max("version")).first()[0]
        rows = t.where(F.col("version") == version).orderBy("vslot").collect()  # a row a slot: fixed size
        edits = spark.read.schema("vslot int, from int, to int, version int").parquet(f"{path}/edits").where(F.col("version") <= version)
        # a move is a row: at most two for each slot and version
        moves = sorted((r["version"], r["vslot"], r["from"], r["to"]) for r in edits.collect())
        return SlotMap([r["shard"] for r in rows], rows[0]["shards"], version, moves)


def records(docs: DataFrame, slots: int = SLOTS, overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, row (a number of its own), vslot of every row."""
    rec = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rec.withColumn("vslot", vslot(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("row"), slots))


def slot_bytes(rec: DataFrame, slots: int = SLOTS) -> tuple[list[int], int]:
    """Bytes of each slot, and the number of rows. One row a slot comes to the driver, however many
    records there are."""
    sizes, rows = [0] * slots, 0
    for r in rec.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        sizes[r["vslot"]] = r["b"]
        rows += r["n"]
    return sizes, rows


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, overhead: int = 8, map_path: str | None = None, grow: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (position within the shard, gapless from 0), vslot. Sizes of shards
    are near equal. The map is planned from the bytes of the slots as version 0, stored at map_path, and read from
    there. With grow=True the latest map at map_path is taken: where its shards have become unequal, or their
    number is another, it is edited, and the next version stored."""
    spark = docs.sparkSession
    rec = stored(records(docs, slots, overhead), "records")
    sizes, rows = slot_bytes(rec, slots)
    path = map_path or scratch(spark, "slot-map")
    if grow:
        m = SlotMap.load(spark, path)
        edited = m.rebalance(sizes, shards)
        if len(edited.edits) > len(m.edits) or edited.shards != m.shards:
            edited.save(spark, path)
    else:
        SlotMap.planned(sizes, shards).save(spark, path)
    m = SlotMap.load(spark, path)
    parts = max(1, -(-rows // (slots * PART_ROWS)))
    rec = rec.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    owner = F.broadcast(m.frame(spark).select("vslot", "shard"))  # a row a slot
    counts = rec.groupBy("vslot", "part").agg(F.count("*").alias("n")).join(owner, "vslot")
    # a row for each slot and part: at most slots + rows / PART_ROWS; one shard's are numbered in one task
    offsets = counts.select("vslot", "part", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("vslot", "part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "row")) - 1
    placed = rec.withColumn("within", within)
    if rows <= 1_000_000_000:  # then offsets have at most slots + 20,000 rows
        offsets = F.broadcast(offsets)
    return placed.join(offsets, ["vslot", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("within")).alias("slot"), "vslot")
