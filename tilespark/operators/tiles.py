"""From features and tiles to encoded features, layers and tiles.

Features become bytes where they are: their geometry is clipped, simplified, wound and encoded by the task that
holds them. Only these bytes are dealt by tile and sorted, and a tile's task puts them in a row while they
stream by. A tile is one binary value, of 2 GB at most, which bounds what such a task can meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.functions import kernels, pbf
from tilespark.functions import tilemath as tm
from tilespark.functions.layers import PIECES, Assembler, Pieces, layer_head
from tilespark.operators import descent
from tilespark.operators.features import BOX
from tilespark.options import Behaviour, Options

#: Encoded features: geometry is commands (points) or their varints (lines and polygons); vals holds a text for
#: each property of the layer, or null.
ENCODED = "z int, x bigint, y bigint, ord int, fid bigint, kind int, cmds array<bigint>, geom binary, vals array<string>, id bigint"
LAYERS = "z int, x bigint, y bigint, ord int, name string, extent int, keys array<string>, values array<struct<t:string,s:string,d:double,i:bigint,b:boolean>>, tags array<array<int>>, features array<struct<id:bigint,type:int,geometry:array<bigint>>>"
TILES = "z int, x bigint, y bigint, pbf binary"


def flat_rings(rings: pa.Array) -> kernels.Rings:
    """Arrow's nested lists as arrays, without copying coordinates."""
    rings = rings.combine_chunks() if isinstance(rings, pa.ChunkedArray) else rings
    outer = np.asarray(rings.offsets)
    parts = rings.flatten()
    feat = np.repeat(np.arange(len(rings)), np.diff(outer))
    pts = parts.field("pts")
    at = np.asarray(pts.offsets).astype(np.int64)
    xy = pts.flatten()
    get = lambda n: xy.field(n).to_numpy(zero_copy_only=False)
    return kernels.Rings(get("x"), get("y"), at - at[0], feat, parts.field("ext").to_numpy(zero_copy_only=False).astype(bool))


def commands_of(b: pa.RecordBatch, o: Options, behaviour: Behaviour) -> tuple[np.ndarray, np.ndarray]:
    """Geometry commands of a batch of lines and polygons with their tiles, one after another, and where each
    feature's begin: clipped, simplified, quantised, wound and encoded."""
    extent, buffer, tolerance = int(o.extent), float(o.buffer), float(o.tolerance)
    kind, z, x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("geom_type", "z", "x", "y"))
    n = (np.ones(len(z), np.int64) << z).astype(float)
    k = buffer / extent
    box = ((x - k) / n, (y - k) / n, (x + 1 + k) / n, (y + 1 + k) / n)
    tol = (tolerance / (n * extent)) ** 2 if tolerance > 0 else np.zeros(len(z))
    t = kernels.Tiles(z, x, y, np.full(len(z), float(extent)), box, tol)
    poly = (kind == g.POLYGON) | (kind == g.MULTIPOLYGON)
    known = (kind >= g.POINT) & (kind <= g.MULTIPOLYGON)  # features of any other type are points in tiles
    return kernels.to_commands(flat_rings(b.column("rings")), poly, t, behaviour.winding, behaviour.drop_flat_parts, ~known, behaviour.ties)


def point_commands(rings: Column, o: Options) -> Column:
    """Commands of points, in the JVM: those within the clip box, quantised."""
    box = tm.clip_box("z", "x", "y", F.lit(o.buffer), F.lit(o.extent))
    pts = g.clip_points(g.all_points(rings), box)
    q = F.transform(pts, lambda p: F.struct(tm.quantize(p["x"], "z", "x", F.lit(o.extent)).alias("x"), tm.quantize(p["y"], "z", "y", F.lit(o.extent)).alias("y")))
    return g.encode_points(q)


def encoded(pairs: DataFrame, o: Options, b: Behaviour = Behaviour(), ord_: int = 0, points_only: bool = False, search=None) -> DataFrame:
    """pairs (prepared features with their tile z, x, y) -> ENCODED; features that leave nothing in the tile are
    dropped. Points alone need no Python here. search: pairs are rows of descent.begun, whose tiles are still to be
    found by it."""
    kind = F.col("geom_type")
    none = F.array().cast("array<bigint>")
    if points_only:
        # one point a feature: plain arithmetic
        p = F.col("rings")[0]["pts"][0]
        x, y = p["x"], p["y"]
        box = tm.clip_box("z", "x", "y", F.lit(o.buffer), F.lit(o.extent))
        within = (x >= box["c_minx"]) & (x <= box["c_maxx"]) & (y >= box["c_miny"]) & (y <= box["c_maxy"])
        at = [g.zigzag(tm.quantize(v, "z", t, F.lit(o.extent))) for v, t in ((x, "x"), (y, "y"))]
        made = pairs.where(within).withColumn("cmds", F.array(F.lit(g.MOVE_TO | 1 << 3).cast("long"), *at))
        return made.select("z", "x", "y", F.lit(ord_).alias("ord"), "fid", F.lit(g.TILE_POINT).alias("kind"), "cmds", F.lit(b"").alias("geom"), "vals", "id")
    points = F.when(g.is_point(kind), point_commands(F.col("rings"), o)).otherwise(none)
    rings = F.when(g.is_point(kind), F.array().cast(g.RINGS)).otherwise(F.col("rings"))
    rows = pairs.select("z", "x", "y", "fid", "geom_type", g.tile_type(kind).alias("kind"), points.alias("cmds"), rings.alias("rings"), "vals", "id", *((*BOX, "state", *descent.MERCATOR) if search else ()))

    def encode(batches):
        for batch in (x for y in batches for x in descent.expand(y, search)) if search else batches:
            values, at = commands_of(batch, o, b)
            raw, size = pbf.varints(values)
            ends = np.r_[0, np.cumsum(size)][at]
            geom = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
            cmds = batch.column("cmds")
            keep = pa.array((np.diff(at) > 0) | (np.diff(np.asarray(cmds.offsets)) > 0))
            own = [batch.column(c) for c in ("z", "x", "y")]
            out = [*own, pa.array(np.full(batch.num_rows, ord_, np.int32)), *(batch.column(c) for c in ("fid", "kind")), cmds, geom.cast(pa.binary()), batch.column("vals"), batch.column("id")]
            yield pa.RecordBatch.from_arrays(out, names=["z", "x", "y", "ord", "fid", "kind", "cmds", "geom", "vals", "id"]).filter(keep)

    return rows.mapInArrow(encode, ENCODED)


def wanted(tiles: DataFrame) -> DataFrame:
    """Rows that say that these tiles are wanted, whether or not there are features in them."""
    null = lambda t: F.lit(None).cast(t)
    none = F.array().cast("array<bigint>")
    return tiles.select(F.col("z").cast("int"), "x", "y", F.lit(-1).alias("ord"), null("bigint").alias("fid"), null("int").alias("kind"), none.alias("cmds"), F.lit(b"").alias("geom"), F.array().cast("array<string>").alias("vals"), null("bigint").alias("id"))


def assembled(rows: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """ENCODED rows of all sources -> z, x, y, pbf. layers: (name, extent, keys) by ord; every tile has them all.
    Features stand in the order of fid."""

    def put(batches) -> Iterator[pa.RecordBatch]:
        a = Assembler(layers)

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["z", "x", "y", "pbf"])

        found: list[tuple] = []
        held = 0
        for batch in batches:
            for t in a.feed(batch):
                found.append(t)
                held += len(t[3])
                if held > 1 << 24:
                    yield out(found)
                    found, held = [], 0
        found += a.finish()
        if found:
            yield out(found)

    return in_order(rows).mapInArrow(put, TILES)


def in_order(rows: DataFrame) -> DataFrame:
    """ENCODED rows dealt by tile, and sorted as layers and tiles have them."""
    dealt = rows.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "ord", "fid", "kind", "geom", "cmds")
    return dealt.select("z", "x", "y", "ord", "kind", "cmds", "geom", "vals", "id")


def in_pieces(rows: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """The same in pieces (functions.layers.PIECES), as they come: no task holds a tile."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(PIECES))

    def put(batches) -> Iterator[pa.RecordBatch]:
        made, found, held = Pieces(layers), [], 0
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
        for piece in chain.from_iterable(f() for f in chain((partial(made.feed, b) for b in batches), [made.finish])):
            found.append(piece)
            held += len(piece[-1])
            if held > 1 << 21:
                yield batch_of(found)
                found, held = [], 0
        if found:
            yield batch_of(found)

    return in_order(rows).mapInArrow(put, PIECES)


def heads(pieces: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """Pieces that stand before all others of their layer (section -1): its field's key and length, version, name and
    extent. All layers of all tiles that have a piece; pieces may have a column size in place of their bytes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(PIECES))
    begin = [layer_head(name, extent) for name, extent, _ in layers]

    def put(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for z, x, y, sizes in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "sizes")), strict=True):
                rows += [(z, x, y, o, -1, 0, 0, 0, 1, b"\x1a" + pbf.varint(n + len(h)) + h) for o, (n, h) in enumerate(zip(sizes, begin, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    size = F.col("size") if "size" in pieces.columns else F.octet_length("bytes").cast("long")
    sums = [F.coalesce(F.sum(F.when(F.col("ord") == i, size)), F.lit(0)) for i in range(len(layers))]
    return pieces.groupBy("z", "x", "y").agg(F.array(*sums).alias("sizes")).mapInArrow(put, PIECES)


def measured(made: DataFrame) -> DataFrame:
    """z, x, y, bytes and sha256 of whole tiles."""
    return made.select("z", "x", "y", F.octet_length("pbf").cast("long").alias("bytes"), F.sha2("pbf", 256).alias("sha256"))


def sizes(pieces: DataFrame, layers: list[tuple[str, int, list[str]]]) -> DataFrame:
    """z, x, y and bytes of tiles from their pieces."""
    both = pieces.unionByName(heads(pieces, layers)).where("ord >= 0")
    return both.groupBy("z", "x", "y").agg(F.sum(F.octet_length("bytes").cast("long")).alias("bytes"))


def digests(pieces: DataFrame) -> DataFrame:
    """z, x, y, bytes and sha256 of tiles from all their pieces, heads among them, which stream by: a tile may be of any
    size."""

    def put(batches) -> Iterator[pa.RecordBatch]:
        tile, size, digest = None, 0, hashlib.sha256()
        names = ["z", "x", "y", "bytes", "sha256"]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*tile, size, digest.hexdigest()), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)
        for b in batches:
            raw = b.column("bytes")
            for i, at in enumerate(zip(*(b.column(c).to_pylist() for c in ("z", "x", "y")), strict=True)):
                if at != tile:
                    if tile is not None:
                        yield row()
                    tile, size, digest = at, 0, hashlib.sha256()
                piece = raw[i].as_buffer()
                size += piece.size
                digest.update(piece)
        if tile is not None:
            yield row()

    dealt = pieces.where("ord >= 0").repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "ord", "section", "run", "part")
    return dealt.select("z", "x", "y", "bytes").mapInArrow(put, "z int, x bigint, y bigint, bytes bigint, sha256 string")


def layers_of(tiles: DataFrame) -> DataFrame:
    """The layers of tiles, read from their bytes: LAYERS."""
    pick = {"string": "s", "double": "d", "uint": "i", "int": "i", "bool": "b"}
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(LAYERS))

    def read(batches):
        for batch in batches:
            rows = []
            for z, x, y, raw in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "pbf")), strict=True):
                for ord_, lay in enumerate(pbf.decode(raw)):
                    values = [{"t": t, "s": None, "d": None, "i": None, "b": None} | {pick[t]: v} for t, v in lay["values"]]
                    features = [{"id": f["id"], "type": f["type"], "geometry": f["commands"]} for f in lay["features"]]
                    rows.append((z, x, y, ord_, lay["name"], lay["extent"], lay["keys"], values, [f["tags"] for f in lay["features"]], features))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return tiles.mapInArrow(read, LAYERS)
