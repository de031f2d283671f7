"""TileEngine: sources in, tiles out. All methods but tile() and tilejson() return lazy DataFrames."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import tilemath as tm
from tilespark.operators import features as ft
from tilespark.operators import assembly, descent, grid, tiles
from tilespark.options import Behaviour, Options, Source, resolve

Box = tuple[float, float, float, float]
#: Tiles of more features are put together in two levels; sources of fewer bytes aren't counted for that.
HOT, SMALL = 1_000_000, 64 << 20
#: Bytes of an Arrow batch.
BATCH = 8 << 20
#: Fixed value: bounds where no source knows its own.
WORLD = (-180.0, -85.0511, 180.0, 85.0511)


def type_label(dtype: str) -> str:
    """What metadata calls a column's type."""
    numbers = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return "Boolean" if dtype == "boolean" else "Number" if dtype in numbers or dtype.startswith("decimal") else "String"


class TileEngine:
    """Serves one tile, a list of tiles or a pyramid from one or more sources."""

    def __init__(self, spark: SparkSession, sources: Source | list[Source], request: Options | None = None, behaviour: Behaviour = Behaviour(), hot: int = HOT):
        self.spark, self.request, self.behaviour, self.hot = spark, request, behaviour, hot
        self.sources = [sources] if isinstance(sources, Source) else list(sources)
        if len({s.name for s in self.sources}) < len(self.sources):
            raise ValueError("layer names must be unique")

    def options(self, s: Source) -> Options:
        return resolve(s.options, self.request)

    def features(self, s: Source) -> DataFrame:
        """A source's features; files are read through the flatgeobuf reader, with the source's connector, each time by a
        DataFrame of its own."""
        if not isinstance(s.data, str):
            return s.data
        from tilespark.sources.flatgeobuf import read

        layout = {"layout": True} if self.behaviour.candidates == "fgb_layout" else {}
        return read(self.spark, s.data, strict_index=self.behaviour.strict_index, **layout, **(s.reading or {}))

    def prepared(self, s: Source, box: Box | None, deal: bool, runs: int = 0) -> DataFrame:
        """A source's features in or around a box, ready for tiles. The box reaches the source's index. deal: all
        tasks get features, however few files there are. runs: features are dealt in so many ranges of fid."""
        f = grid.within(ft.with_box(self.features(s)), box)
        if runs:  # before they are prepared, as they are sampled for it
            return ft.prepared(f.repartitionByRange(runs, "fid"), s.columns, s.id_col)
        f = ft.prepared(f, s.columns, s.id_col)
        return f.repartition("fid") if deal and s.deal else f

    def encoded(self, grid_tiles: DataFrame | None, few: bool | None = None, zooms: list[int] | None = None, around: Box | None = None, box: Box | None = None, pick=None) -> DataFrame:
        """Encoded features of all sources with their tiles (tiles.ENCODED). Without a table of tiles: all tiles of
        the zooms, or those that a box meets, in which there are features. around: a box in degrees with all these
        tiles, if known. Sources outside their zooms aren't read at all where zooms are known. pick: which features with their
        tiles are encoded."""
        out = None
        for ord_, s in enumerate(self.sources):
            o = self.options(s)
            own = [z for z in zooms if o.min_zoom <= z <= o.max_zoom] if zooms is not None else None
            if own == []:
                continue
            buffered = self.behaviour.candidates == "buffered"
            # a tile's buffer widens the box by as much as a tile of the lowest zoom
            near = None if self.behaviour.candidates == "fgb_layout" else around if around is None or not buffered else grid.widened(around, min(own or [0]), o.buffer / o.extent)
            f = self.prepared(s, near, not few)
            layout = self.behaviour.candidates == "fgb_layout"
            if layout and not {"byte_at", "byte_end"} <= set(f.columns):
                raise ValueError(f"{s.name}: candidates by layout need the columns byte_at and byte_end")
            how = "buffered" if buffered else "tile"
            search = None
            if grid_tiles is None and (layout or ft.only_points(self.features(s))):
                pairs = grid.own_tiles(f, own, how, o.buffer, o.extent, box)
            elif grid_tiles is None and pick:  # tiles are named before they are picked
                pairs = descent.tiles_of(f, own, how, o.buffer, o.extent, box)
            elif grid_tiles is None:
                pairs, search = descent.begun(f, own, how, o.buffer, o.extent, box)
            else:
                pairs = grid.cover_join(f, grid_tiles.where(F.col("z").between(o.min_zoom, o.max_zoom)), o.buffer, o.extent, how, own, few)
            if layout:  # neighbours in the file may lie anywhere, so the source isn't narrowed to a box
                pairs = grid.by_layout(pairs, f, o.buffer, o.extent)
            rows = tiles.encoded(pick(pairs) if pick else pairs, o, self.behaviour, ord_, ft.only_points(self.features(s)), search)
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], tiles.ENCODED)

    def of_crowded(self, crowd: list[tuple[int, int, int]], around: Box | None = None) -> DataFrame:
        """Encoded features of crowded tiles, in partitions that follow each other in fid within a source: features are
        dealt once, and not their rows for each tile."""
        out = None
        for ord_, s in enumerate(self.sources):
            o = self.options(s)
            own = [t for t in crowd if o.min_zoom <= t[0] <= o.max_zoom]
            if not own:
                continue
            how = "buffered" if self.behaviour.candidates == "buffered" else "tile"
            zooms = sorted({t[0] for t in own})
            near = around if around is None or how == "tile" else grid.widened(around, zooms[0], o.buffer / o.extent)
            f = self.prepared(s, near, False, max(1, -(-self.counted.get(s.name, assembly.RUN) * len(zooms) // assembly.RUN)))
            few, boxes = len(own) <= grid.FEW_TILES, F.broadcast(grid.tiles_frame(self.spark, own))  # they are few
            pairs = grid.cover_join(f, boxes, o.buffer, o.extent, how, zooms, True) if few else grid.own_tiles(f, zooms, how, o.buffer, o.extent).join(boxes, ["z", "x", "y"], "left_semi")
            rows = tiles.encoded(pairs, o, self.behaviour, ord_, ft.only_points(self.features(s)))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], tiles.ENCODED)

    def named(self) -> list[tuple[str, int, list[str]]]:
        """Name, extent and keys of each layer."""
        return [(s.name, self.options(s).extent, [n for n, _ in ft.keys_of(self.features(s), s.columns)]) for s in self.sources]

    def crowded(self, zooms: list[int], around: Box | None = None) -> DataFrame | None:
        """The tiles of these zooms with more than `hot` candidates of a layer, by the boxes of features alone; None if
        there are none. Tiles below one that isn't crowded aren't, so zooms are looked at from the top, below crowded
        tiles only; each feature adds to few of these, so that they are few. around: a box with all tiles in question."""
        found: list[tuple[int, int, int]] = []
        self.counted: dict[str, int] = {}
        for s in self.sources:
            o = self.options(s)
            if isinstance(s.data, str) and self.header(s).count <= self.hot:
                continue
            f = grid.within(ft.with_box(self.features(s)), around)
            size = int(str(f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            if size <= SMALL and self.hot >= HOT:
                continue
            n = self.counted[s.name] = f.count()
            if n <= self.hot:
                continue
            f, above, last = f.select("fid", *ft.BOX), None, 0
            for z in sorted(z for z in zooms if o.min_zoom <= z <= o.max_zoom):
                t = grid.own_tiles(f, [z], "buffered" if self.behaviour.candidates == "buffered" else "tile", o.buffer, o.extent)
                if above is not None:
                    up = lambda c: F.shiftright(c, z - last).alias(c)  # noqa: B023,E731
                    t = t.select("z", "x", "y", up("x").alias("ax"), up("y").alias("ay")).join(F.broadcast(above.select(F.col("x").alias("ax"), F.col("y").alias("ay"))), ["ax", "ay"], "left_semi")
                crowd = [tuple(r) for r in t.groupBy("z", "x", "y").count().where(F.col("count") > self.hot).select("z", "x", "y").collect()]
                if not crowd:
                    break
                found += crowd
                above, last = grid.tiles_frame(self.spark, crowd), z
        return grid.tiles_frame(self.spark, sorted(set(found))) if found else None

    def put_together(self, encoded, wanted: DataFrame | None, zooms: list[int], around: Box | None, calm=None, many=None):
        """Tiles of encoded features: encoded(pick) gives those of the pairs that are picked. wanted: tiles that are made
        whether or not there are features in them. calm makes the result from encoded features, many from pieces of
        crowded tiles; without them that are whole tiles."""
        calm, many = calm or tiles.assembled, many or assembly.whole_of
        # features, partial layers and pieces are large rows: this lowers the session's setting, a smaller one stays
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not 0 < int(re.sub(r"\D", "", self.spark.conf.get(key)) or 0) <= BATCH:
            self.spark.conf.set(key, str(BATCH))
        crowd, named = self.crowded(zooms, around), self.named()
        if crowd is None:
            rows = encoded(None)
            return calm(rows if wanted is None else rows.unionByName(tiles.wanted(wanted)), named)
        # a row for each million features of a zoom at most
        split = lambda how: lambda df: df.join(F.broadcast(crowd), ["z", "x", "y"], how)
        rows = encoded(split("left_anti"))
        rest = calm(rows if wanted is None else rows.unionByName(tiles.wanted(split("left_anti")(wanted))), named)
        asked = crowd if wanted is None else split("left_semi")(wanted.select(F.col("z").cast("int"), "x", "y"))  # crowded tiles that weren't asked for have no rows
        asked = [tuple(r) for r in asked.distinct().collect()]
        if self.behaviour.candidates == "fgb_layout":  # rows come by bytes, whatever the fid
            found = encoded(split("left_semi"))
            found = assembly.in_pieces(found.join(F.broadcast(grid.tiles_frame(self.spark, asked)), ["z", "x", "y"], "left_semi"), named)
        else:
            found = assembly.in_pieces(self.of_crowded(asked, around), named, ordered=True)
        return rest.unionByName(many(found, named))

    def counts(self, grid_tiles: DataFrame, few: bool | None = None, zooms: list[int] | None = None) -> DataFrame:
        """z, x, y, ord, n: how many features each layer of each tile has, empty layers included. Features that leave
        nothing in a tile don't count, so geometry is built, but not gathered."""
        grid_tiles = grid.held(grid_tiles)
        ords = F.array(*[F.lit(i) for i in range(len(self.sources))])
        bare = grid_tiles.select("z", "x", "y", F.explode(ords).alias("ord"), F.lit(0).alias("one"))
        found = self.encoded(grid_tiles, few, zooms).select("z", "x", "y", "ord", F.lit(1).alias("one"))
        return found.unionByName(bare).groupBy("z", "x", "y", "ord").agg(F.sum("one").alias("n"))

    def layer_structs(self, grid_tiles: DataFrame) -> DataFrame:
        """Layers for inspection, read from the tiles' bytes: name, extent, features, keys, values, tags."""
        return tiles.layers_of(self.tiles(grid_tiles))

    def tiles(self, grid_tiles: DataFrame, few: bool | None = None, zooms: list[int] | None = None, around: Box | None = None, calm=None, many=None) -> DataFrame:
        """z, x, y, pbf of each tile; a layer for each source, in their order."""
        grid_tiles = grid.held(grid_tiles)
        levels = zooms if zooms is not None else sorted(r[0] for r in grid_tiles.select("z").distinct().collect())  # 31 at most
        return self.put_together(lambda pick: self.encoded(grid_tiles, few, zooms, around, pick=pick), grid_tiles, levels, around, calm, many)

    def pieces(self, grid_tiles: DataFrame, few: bool | None = None, zooms: list[int] | None = None) -> DataFrame:
        """The same tiles in pieces (functions.layers.PIECES), for readers that needn't hold a tile."""
        return self.tiles(grid_tiles, few, zooms, None, tiles.in_pieces, lambda found, _: found)

    def sizes(self, grid_tiles: DataFrame, few: bool | None = None, zooms: list[int] | None = None) -> DataFrame:
        """z, x, y, bytes of each tile, whatever its size."""
        return self.tiles(grid_tiles, few, zooms, None, lambda rows, named: tiles.measured(tiles.assembled(rows, named)).drop("sha256"), lambda found, named: tiles.sizes(found, named))

    def tile(self, z: int, x: int, y: int) -> bytes:
        """One tile, now. Sources read what its box meets."""
        tm.check_tile(z, x, y)
        rows = self.tile_list([(z, x, y)]).collect()
        return bytes(rows[0]["pbf"]) if rows else b""

    def tile_list(self, wanted: list[tuple[int, int, int]]) -> DataFrame:
        found = grid.tiles_frame(self.spark, wanted)
        return self.tiles(found, few=len(wanted) <= grid.FEW_TILES, zooms=sorted({t[0] for t in wanted}), around=grid.degrees_of(wanted) if wanted else None)

    def pyramid(self, min_zoom: int, max_zoom: int, box: Box | None = None, empty: bool = True, calm=None, many=None) -> DataFrame:
        """All tiles of some zooms in one job; with empty=False those alone in which there are features, which is
        what deep zooms need: the work then follows the features and not the number of tiles."""
        zooms = list(range(min_zoom, max_zoom + 1))
        every = grid.pyramid(self.spark, min_zoom, max_zoom, box) if empty else None
        around = None if box is None else grid.around(zooms, box)
        return self.put_together(lambda pick: self.encoded(None, False, zooms, around, box, pick), every, zooms, around, calm, many)

    def pyramid_pieces(self, min_zoom: int, max_zoom: int, box: Box | None = None, empty: bool = True) -> DataFrame:
        """The tiles of a pyramid in pieces (functions.layers.PIECES)."""
        return self.pyramid(min_zoom, max_zoom, box, empty, tiles.in_pieces, lambda found, _: found)

    def pyramid_digests(self, min_zoom: int, max_zoom: int, box: Box | None = None, empty: bool = True) -> DataFrame:
        """z, x, y, bytes and sha256 of each tile of a pyramid, whatever its size."""
        return self.pyramid(min_zoom, max_zoom, box, empty, lambda rows, named: tiles.measured(tiles.assembled(rows, named)), lambda found, named: tiles.digests(found.unionByName(tiles.heads(found, named))))

    def tilejson_frame(self) -> DataFrame:
        """Metadata in one row: tilejson, bounds, minzoom, maxzoom, vector_layers. Bounds of files come from their
        headers; those of other sources are aggregated by the executors. Fields come from schemas."""
        boxes, layers = None, []
        for s in self.sources:
            df, o = self.features(s), self.options(s)
            fields = {n: type_label(t) for n, t in ft.property_columns(df, s.columns)}
            layers.append({"id": s.name, "fields": fields, "minzoom": o.min_zoom, "maxzoom": o.max_zoom})
            known = self.header_box(s)
            b = ft.with_box(df).select(*ft.BOX) if known is None else self.spark.createDataFrame([known], ", ".join(f"{c} double" for c in ft.BOX))
            boxes = b if boxes is None else boxes.unionByName(b)
        low, high = min((v["minzoom"] for v in layers), default=0), max((v["maxzoom"] for v in layers), default=0)
        agg = boxes.agg(*[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in ft.BOX])
        bounds = [F.coalesce(F.col(c), F.lit(w)) for c, w in zip(ft.BOX, WORLD, strict=True)]
        # a greatest zoom of 0 is reported as 24
        return agg.select(F.lit("3.0.0").alias("tilejson"), F.array(*bounds).alias("bounds"), F.lit(low).alias("minzoom"), F.lit(high or 24).alias("maxzoom"), F.lit(json.dumps(layers)).alias("vector_layers"))

    def header(self, s: Source):
        """The header of a source that is a file."""
        from tilespark.sources.flatgeobuf import header_of

        return header_of(s.data, s.reading or {})

    def header_box(self, s: Source) -> Box | None:
        """The box that a file's header gives, or None."""
        return self.header(s).box if isinstance(s.data, str) else None

    def tilejson(self) -> dict:
        if not self.sources:
            return {"tilejson": "3.0.0", "bounds": list(WORLD), "minzoom": 0, "maxzoom": 24, "vector_layers": []}
        r = self.tilejson_frame().first()
        return {"tilejson": r["tilejson"], "bounds": list(r["bounds"]), "minzoom": r["minzoom"], "maxzoom": r["maxzoom"], "vector_layers": json.loads(r["vector_layers"])}

    def close(self) -> None:
        """Forgets what was read, headers too; the engine can be used again."""
        from tilespark.sources.flatgeobuf import forget

        forget()
