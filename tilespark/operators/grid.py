"""Tile grids, and which features go to which tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import tilemath as tm
from tilespark.operators.features import BOX
from tilespark.sources.ranges import GAP, merge_ranges

#: Up to so many tiles are broadcast and compared with every feature; more are joined by cells.
FEW_TILES = 128
#: A feature is dealt to cells of a zoom at which it spans about so many.
SPAN = 4
#: Bytes of a file in which features and merged ranges meet.
BLOCK = 4096


def tiles_frame(spark: SparkSession, tiles: list[tuple[int, int, int]]) -> DataFrame:
    for z, x, y in tiles:
        tm.check_tile(z, x, y)
    return spark.createDataFrame(tiles, "z int, x long, y long")


def _column_range(z: int, box: tuple[float, float, float, float] | None) -> tuple[int, int, int, int]:
    n = 1 << z
    if box is None:
        return 0, 0, n - 1, n - 1
    minx, miny, maxx, maxy = box

    def row(lat: float) -> float:
        lat = min(max(lat, -85.05112877980659), 85.05112877980659)
        s = math.sin(math.radians(lat))
        return 0.5 - 0.25 * math.log((1 + s) / (1 - s)) / math.pi

    at = lambda v: min(max(int(math.floor(v * n)), 0), n - 1)
    return at(minx / 360 + 0.5), at(row(maxy)), at(maxx / 360 + 0.5), at(row(miny))


def pyramid(spark: SparkSession, min_zoom: int, max_zoom: int, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """All tiles of some zooms, or those that a box in degrees meets; made by the executors."""
    if not 0 <= min_zoom <= max_zoom <= tm.MAX_ZOOM:
        raise ValueError("zooms are 0 to 30")
    out = None
    for z in range(min_zoom, max_zoom + 1):
        x0, y0, x1, y1 = _column_range(z, box)
        w = x1 - x0 + 1
        one = spark.range(w * (y1 - y0 + 1)).select(F.lit(z).alias("z"), (F.col("id") % w + x0).alias("x"), (F.floor(F.col("id") / w) + y0).cast("long").alias("y"))
        out = one if out is None else out.union(one)
    return out


def meets(box: tuple[str, ...] = BOX) -> Column:
    """The tile's own box in degrees meets the feature's; touching counts."""
    return tm.boxes_meet(box, ("w_minx", "w_miny", "w_maxx", "w_maxy"))


def meets_buffered() -> Column:
    """The tile's box with its buffer meets the feature's, in Mercator units."""
    return tm.boxes_meet((tm.project_x("minx"), tm.project_y("maxy"), tm.project_x("maxx"), tm.project_y("miny")), ("c_minx", "c_miny", "c_maxx", "c_maxy"))


def sure(box: tuple[str, ...]) -> Column:
    """A box in Mercator units reaches into the tile by more than any rounding: it needn't be compared in degrees."""
    n, eps = tm.tiles_across("z").cast("double"), 1e-6
    x0, y0, x1, y1 = (F.col(c) * n for c in box)
    return (x0 < F.col("x") + 1 - eps) & (x1 > F.col("x") + eps) & (y0 < F.col("y") + 1 - eps) & (y1 > F.col("y") + eps)


def with_boxes(tiles: DataFrame, buffer: int, extent: int) -> DataFrame:
    return tiles.withColumns(tm.tile_box("z", "x", "y") | tm.clip_box("z", "x", "y", F.lit(buffer), F.lit(extent)))


def theta_join(features: DataFrame, tiles: DataFrame, predicate: Column) -> DataFrame:
    """For few tiles: each feature is compared with all of them. tiles must be at most FEW_TILES rows."""
    return features.join(F.broadcast(tiles), predicate)


def cells(features: DataFrame, zooms: list[int], pad: Column | None = None) -> DataFrame:
    """Features with the cells (z, cz, cx, cy) in which to look for tiles of zoom z: cells of the zoom cz at
    which the feature's box, widened by `pad` tiles, spans about SPAN. A feature that covers the world gets
    a few cells of a low zoom, so no feature makes more than some dozens of rows a zoom. Boxes are
    widened by a millionth of a cell, as touching counts."""
    pad = F.lit(0.0) if pad is None else pad
    f = features.withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    x0, x1, y0, y1 = tm.project_x("minx"), tm.project_x("maxx"), tm.project_y("maxy"), tm.project_y("miny")
    n = tm.tiles_across("z").cast("double")
    span = F.greatest((x1 - x0) * n, (y1 - y0) * n, F.lit(1.0))
    drop = F.greatest(F.ceil(F.log2(span / SPAN)), F.lit(0)).cast("int")
    f = f.withColumn("cz", F.greatest(F.col("z") - drop, F.lit(0)).cast("int"))
    m = tm.tiles_across("cz")
    wide = pad / tm.tiles_across("z")
    hold = lambda c: F.least(F.greatest(c, F.lit(0)), m - 1)
    run = lambda a, b: F.sequence(hold(F.floor((a - wide) * m - 1e-6)), hold(F.floor((b + wide) * m + 1e-6)))
    ok = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))  # not so for features without a point
    f = f.where(ok).withColumn("cx", F.explode(run(x0, x1)))
    return f.withColumn("cy", F.explode(run(y0, y1)))


def cell_join(features: DataFrame, tiles: DataFrame, zooms: list[int], predicate: Column, pad: Column | None = None) -> DataFrame:
    """For any number of tiles: an equi-join on cells, then the exact predicate. A tile stands in the cell of
    each zoom above it (at most 31 rows); each pair meets in one cell only, as a feature uses one zoom."""
    t = tiles.withColumn("cz", F.explode(F.sequence(F.lit(0), F.col("z"))))
    t = t.withColumn("cx", F.expr("shiftright(x, z - cz)")).withColumn("cy", F.expr("shiftright(y, z - cz)"))
    return cells(features, zooms, pad).join(t, ["z", "cz", "cx", "cy"]).where(predicate).drop("cz", "cx", "cy")


def held(tiles: DataFrame) -> DataFrame:
    """A table of few tiles as a local one, so that it is made once however many sources it meets; a larger one as it
    is."""
    rows = tiles.select("z", "x", "y").limit(FEW_TILES + 1).collect()
    return tiles.sparkSession.createDataFrame(rows, "z int, x long, y long") if len(rows) <= FEW_TILES else tiles


def cover_join(features: DataFrame, tiles: DataFrame, buffer: int, extent: int, candidates: str = "tile", zooms: list[int] | None = None, few: bool | None = None) -> DataFrame:
    """Features with the tiles (z, x, y, their boxes) that they may appear in. How depends on the number of
    tiles, which is counted up to FEW_TILES unless told."""
    boxed = with_boxes(tiles, buffer, extent)
    predicate = meets() if candidates == "tile" else meets_buffered()
    if few is None:
        few = len(tiles.limit(FEW_TILES + 1).collect()) <= FEW_TILES
    if few:
        return theta_join(features, boxed, predicate)
    zooms = zooms or sorted(r[0] for r in tiles.select("z").distinct().collect())  # 31 at most
    return cell_join(features, boxed, zooms, predicate, F.lit(buffer / extent) if candidates == "buffered" else None)


def own_tiles(features: DataFrame, zooms: list[int], candidates: str = "tile", buffer: int = 0, extent: int = 1, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Features with the tiles of some zooms (of a box in degrees, or all) that they may appear in, without a
    table of tiles: each feature names the tiles that its box meets. Rows are those of the result, and a few
    beside tiles' edges, which the exact predicate removes."""
    pad = F.lit(buffer / extent if candidates == "buffered" else 0.0) + F.lit(1e-6)
    ranges = [_column_range(z, box) for z in zooms]
    level = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), *(F.lit(v).cast("long").alias(c) for v, c in zip(r, ("x0", "y0", "x1", "y1"), strict=True))) for z, r in zip(zooms, ranges, strict=True)]))
    ok = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))  # not so for features without a point
    own = {"_x0": tm.project_x("minx"), "_y0": tm.project_y("maxy"), "_x1": tm.project_x("maxx"), "_y1": tm.project_y("miny")}  # once a feature
    f = features.where(ok).withColumns(own).withColumn("_l", level).withColumn("z", F.col("_l.z"))
    n = tm.tiles_across("z").cast("double")

    def run(low: str, high: str, first: str, last: str) -> Column:
        a = F.greatest(F.floor(F.col(low) * n - pad), F.col(f"_l.{first}"))
        b = F.least(F.floor(F.col(high) * n + pad), F.col(f"_l.{last}"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    f = f.withColumn("x", F.explode(run("_x0", "_x1", "x0", "x1")))
    f = f.withColumn("y", F.explode(run("_y0", "_y1", "y0", "y1"))).drop("_l")
    exact = meets() if candidates == "tile" else meets_buffered()
    return with_boxes(f, buffer, extent).where(sure(tuple(own)) | exact).drop(*own)


def by_layout(hits: DataFrame, features: DataFrame, buffer: int, extent: int, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """What a reader of byte ranges passes on: hits (features with their tiles) and all that lies between them. The
    byte ranges of a tile's hits are merged over gaps, and features whose bytes lie in a merged range belong to the
    tile too, wherever they are; cutting decides. features have byte_at and byte_end; files are told apart by byte_file,
    if there is such a column. Islands meet features in blocks of the file, so a feature meets few islands of a tile."""
    file = F.col("byte_file") if "byte_file" in features.columns else F.lit("")
    tile = F.concat_ws("/", "z", "x", "y", file)
    found = merge_ranges(hits.select(tile.alias("tile"), F.col("byte_at").alias("offset"), (F.col("byte_end") - F.col("byte_at")).alias("length")), gap, "tile")
    of = lambda c: F.floor(c / block).cast("long")
    end = F.col("offset") + F.col("length")
    isle = found.select("tile", "offset", end.alias("_end"), F.explode(F.sequence(of(F.col("offset")), of(end - 1))).alias("_block"))
    # a feature stands in the block in which its bytes begin
    placed = features.withColumn("_file", file).withColumn("_block", of(F.col("byte_at")))
    inside = (F.col("byte_at") >= F.col("offset")) & (F.col("byte_end") <= F.col("_end"))
    told = F.split("tile", "/", 4)
    both = placed.join(isle.withColumn("_file", told[3]), ["_file", "_block"]).where(inside)
    both = both.withColumns({c: told[i].cast("int" if c == "z" else "long") for i, c in enumerate("zxy")}).drop("_file", "_block", "_end", "offset", "tile")
    return with_boxes(both, buffer, extent)


def degrees_of(tiles: list[tuple[int, int, int]], pad: float = 0.0) -> tuple[float, float, float, float]:
    """The box in degrees around some tiles, each widened by `pad` tiles, and a little for rounding."""

    def lat(y: float, n: int) -> float:
        return math.degrees(math.atan(math.sinh(min(max(math.pi - 2 * math.pi * y / n, -700.0), 700.0))))

    boxes = [((x - pad) / n * 360 - 180, lat(y + 1 + pad, n), (x + 1 + pad) / n * 360 - 180, lat(y - pad, n)) for z, x, y in tiles for n in (1 << z,)]
    return tuple(f(b[k] for b in boxes) + d for k, (f, d) in enumerate(((min, -1e-9), (min, -1e-9), (max, 1e-9), (max, 1e-9))))


def widened(box: tuple[float, float, float, float], z: int, pad: float) -> tuple[float, float, float, float]:
    """A box in degrees, wider by `pad` tiles of a zoom on each side (in latitude by as much as at the equator)."""
    d = pad * 360 / (1 << z)
    return box[0] - d, box[1] - d, box[2] + d, box[3] + d


def around(zooms: list[int], box: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """The box in degrees of all tiles of these zooms that a box meets: those of the lowest zoom hold the others."""
    z = min(zooms)
    x0, y0, x1, y1 = _column_range(z, box)
    return degrees_of([(z, x0, y0), (z, x1, y1)])


def within(features: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Features whose box meets a box in degrees, told by literals on the box columns, which sources can push
    into their indexes and statistics."""
    if box is None:
        return features
    return features.where((F.col("minx") <= box[2]) & (F.col("maxx") >= box[0]) & (F.col("miny") <= box[3]) & (F.col("maxy") >= box[1]))
