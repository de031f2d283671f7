"""Tiles with very many features, put together in two levels.

Where a tile's features are few, one task numbers its dictionaries while they stream by (functions.layers). A tile that
holds millions, as those of low zooms do, is dealt in runs instead: encoded features are range-partitioned by tile,
layer and fid, or come from features that were dealt in ranges of fid, and each run becomes partial layers with
dictionaries of their own. An item's number in the whole
layer follows from where it appears first: items are aggregated to their first partial layer, numbered there, and
moved on by how many new ones the partial layers before it have. Each partial layer then gets its tags
renumbered and its features written by itself. That gives the tile in pieces (functions.layers.PIECES), which can be read,
measured and digested as they are; what meets in one task where the tile is asked for as one value are ready bytes.
Tiles of more than 2 GB raise then, as no such value exists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.functions import layers as ly
from tilespark.functions import pbf
from tilespark.sources.shared import discard, stored

#: Features in a run, and bytes that a tile may have.
RUN, MOST = 200_000, (1 << 31) - (1 << 16)

AT = ["z", "x", "y", "ord"]
PART = [*AT, "run", "part"]
PARTS = "z int, x bigint, y bigint, ord int, run int, part int, keys array<int>, texts array<string>, kinds array<int>, ids array<bigint>, geoms array<binary>, per array<int>, tags array<int>"
NAMES = [c.split()[0] for c in ly.PIECES.split(", ")]


def partial(batches) -> Iterator[pa.RecordBatch]:
    """Partial layers of sorted encoded features: one for each stretch of a layer in a batch."""
    run, part = TaskContext.get().partitionId(), 0
    for b in batches:
        if not b.num_rows:
            continue
        at = [b.column(c).to_numpy() for c in AT]
        begin = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in at], axis=0)])
        of = np.searchsorted(begin, np.arange(b.num_rows), "right") - 1
        vals = b.column("vals")
        per, flat = ly.list_offsets(vals), vals.flatten()
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(there)).dictionary_encode()
        row = np.repeat(np.arange(b.num_rows), np.diff(per))
        key, row = (np.arange(len(flat)) - per[row])[there], row[there]
        key_no, key_at, keys = ly.numbered(of[row], key)
        value_no, value_at, values = ly.numbered(of[row], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        size = np.bincount(row, minlength=b.num_rows)
        cut = lambda where: pa.array(np.searchsorted(where, np.arange(len(begin) + 1)).astype(np.int32))
        rows = pa.array(np.r_[begin, b.num_rows].astype(np.int32))
        raw, sizes = ly.in_a_row([ly.command_pieces(b.column("cmds")), ly.byte_pieces(b.column("geom"))])
        geoms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(raw)]).cast(pa.binary())
        lists = [
            (cut(key_at), pa.array(keys.astype(np.int32))), (cut(value_at), coded.dictionary.take(pa.array(values))), (rows, pc.fill_null(b.column("kind"), 0)), (rows, b.column("id")), (rows, geoms),
            (rows, pa.array(size.astype(np.int32))), (pa.array(2 * np.searchsorted(of[row], np.arange(len(begin) + 1)).astype(np.int32), pa.int32()), pa.array(np.stack([key_no, value_no], 1).ravel().astype(np.int32))),
        ]
        n = len(begin)
        cols = [*(pa.array(c[begin], t) for c, t in zip(at, (pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)), pa.array([run] * n, pa.int32()), pa.array(np.arange(part, part + n), pa.int32())]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.ListArray.from_arrays(o, v) for o, v in lists)], names=[c.split()[0] for c in PARTS.split(", ")])
        part += n


def numbered_items(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each item (what: 0 key, 1 value) of a layer its number, and the partial layer in which it is new; and for each
    partial layer the numbers of its own items, in their order there (keys, texts)."""
    item = lambda c, what: F.transform(c, lambda v, i: F.struct(F.lit(what).alias("what"), v.cast("string").alias("item"), i.alias("pos")))
    entries = parts.select(*PART, F.explode(F.concat(item("keys", 0), item("texts", 1))).alias("e")).select(*PART, "e.*")
    kind = [*AT, "what"]
    new = entries.groupBy(*kind, "item").agg(F.min(F.struct("run", "part", "pos")).alias("f")).select(*kind, "item", "f.*")
    own = Window.partitionBy(*kind, "run", "part").orderBy("pos")  # the items of one partial layer
    counts = new.groupBy(*kind, "run", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*kind).orderBy("run", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partial layer
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbers = new.join(base, [*kind, "run", "part"]).withColumn("number", (F.col("base") + F.row_number().over(own) - 1).cast("int")).drop("base")
    numbers = stored(numbers, "tile-dictionaries")
    known = entries.join(numbers.select(*kind, "item", "number"), [*kind, "item"])
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("pos", "number")))), lambda s: s["number"])
    return numbers, known.groupBy(*PART).agg(in_order(0).alias("key_no"), in_order(1).alias("text_no"))


def features_of(batches) -> Iterator[pa.RecordBatch]:
    """The bytes of each partial layer's features, with tags renumbered."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c: b.column(c)[i].values  # noqa: E731,B023
            kinds, per, ids = (get(c) for c in ("kinds", "per", "ids"))
            tags = get("tags").to_numpy().reshape(-1, 2) if len(get("tags")) else np.zeros((0, 2), np.int64)
            if len(tags):
                tags = np.stack([get(n).to_numpy()[tags[:, k]] for k, n in enumerate(("key_no", "text_no"))], 1)
            raw, size = pbf.varints(tags.ravel().astype(np.int64))
            per = per.to_numpy()
            size = np.bincount(np.repeat(np.repeat(np.arange(len(per)), per), 2), size, len(per)).astype(np.int64)
            made, _ = ly.feature_fields(kinds.to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), (raw, size), [ly.byte_pieces(get("geoms"))])
            own = [b.column(c).slice(i, 1) for c in (*AT, "run", "part")]
            yield pa.RecordBatch.from_arrays([*own[:4], pa.array([2], pa.int32()), *own[4:], pa.array([0], pa.int64()), pa.array([len(per)], pa.int32()), pa.array([made.tobytes()], pa.binary())], names=NAMES)


def in_pieces(rows: DataFrame, layers: list[tuple[str, int, list[str]]], run: int = RUN, ordered: bool = False) -> DataFrame:
    """Encoded features (tiles.ENCODED) of tiles with very many, in pieces; layers as functions.layers has them. ordered:
    partitions of rows follow each other in fid, so that rows stay where they are."""
    kept = []
    if not ordered:
        kept.append(rows := stored(rows, "tile-features"))  # they are counted, sampled and dealt
        rows = rows.repartitionByRange(max(1, -(-rows.count() // run)), *AT, "fid")
    dealt = rows.sortWithinPartitions(*AT, "fid", "kind", "geom", "cmds")
    kept.append(parts := stored(dealt.select(*AT, "kind", "cmds", "geom", "vals", "id").mapInArrow(partial, PARTS), "tile-parts"))
    numbers, own = numbered_items(parts)
    kept.append(numbers)
    names = [[pbf.field(3, k.encode()) for k in keys] for _, _, keys in layers]

    def dictionary(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                o, w, first, items = (b.column(c)[i].as_py() for c in ("ord", "what", "first", "items"))
                raw = b"".join(names[o][int(t)] if w == 0 else pbf.field(4, ly.value_message(t)) for t in items)
                own = [b.column(c).slice(i, 1) for c in (*AT, "what", "run", "part", "first")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(items)], pa.int32()), pa.array([raw], pa.binary())], names=NAMES)

    fresh = numbers.groupBy(*AT, "what", "run", "part").agg(F.min("number").cast("long").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("number", "item"))), lambda s: s["item"]).alias("items"))
    pieces = stored(fresh.mapInArrow(dictionary, ly.PIECES).unionByName(parts.drop("keys", "texts").join(own, PART, "left").mapInArrow(features_of, ly.PIECES)), "tile-pieces")
    discard(*kept)
    return pieces


def assembled(rows: DataFrame, layers: list[tuple[str, int, list[str]]], run: int = RUN) -> DataFrame:
    """Encoded features (tiles.ENCODED) of tiles with very many -> z, x, y, pbf; layers as functions.layers has them."""
    return whole_of(in_pieces(rows, layers, run), layers)


def whole_of(pieces: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """Tiles, each as one value, from their pieces."""
    heads = [ly.layer_head(n, e) for n, e, _ in layers]

    def whole(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                made: list[list[bytes]] = [[] for _ in layers]
                for p in b.column("pieces")[i]:
                    made[p["ord"].as_py()].append(p["bytes"].as_buffer())
                pbf_ = b"".join(pbf.field(3, b"".join([h, *m])) for h, m in zip(heads, made, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(c).slice(i, 1) for c in "zxy"] + [pa.array([pbf_], pa.binary())], names=["z", "x", "y", "pbf"])

    found = pieces.groupBy("z", "x", "y").agg(F.sum(F.octet_length("bytes").cast("long")).alias("size"), F.array_sort(F.collect_list(F.struct("ord", "section", "run", "part", "bytes"))).alias("pieces"))
    bounded = F.when(F.col("size") > MOST, F.raise_error(F.concat(F.lit("a tile is one value of 2 GB at most: "), F.concat_ws("/", "z", "x", "y")))).otherwise(F.col("pieces"))
    return found.select("z", "x", "y", bounded.alias("pieces")).mapInArrow(whole, "z int, x bigint, y bigint, pbf binary")
