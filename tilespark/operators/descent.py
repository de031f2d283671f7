"""Which tiles lines and polygons appear in, by descent through the quad-tree.

A feature's box says little at depth: a diagonal line, or a border, meets few of the tiles that its box covers. So a
feature is listed by its box only down to the zoom at which that spans about two tiles. From there each tile asks its
four children: those in which a cut of the geometry leaves nothing end there. What goes on to a child is the
geometry without the vertices that no cut within the child's clip box can need (kernels.thinned), so vertices are met
about once a zoom, whatever the number of tiles. A polygon that fills a child's clip box does so in all tiles below:
these are named at once, without another look.

The cut geometry itself isn't handed on: cutting in steps would begin rings elsewhere and lose the rings of no area
that a single cut leaves along a box's edge. With thinned geometry each tile is just as if it had been cut
from the whole feature. Work is dealt once on the way, as one feature can have very many tiles. Features
without a vertex have no tiles; points aren't cut and go by their box.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.functions import kernels
from tilespark.functions import tilemath as tm
from tilespark.operators import grid
from tilespark.operators.features import BOX

#: Features that span so many tiles at most are listed by their box.
SPAN = 2
#: Zooms that a task descends before what is left is dealt again.
STEP = 5
#: Rows and vertices that are cut together.
ROWS, VERTICES = 20_000, 400_000

COLUMNS = ("fid", "geom_type", *BOX, "rings", "vals", "id", "z", "x", "y")
MERCATOR = ("mx0", "my0", "mx1", "my1")
SCHEMA = f"fid bigint, geom_type int, {', '.join(f'{c} double' for c in BOX)}, rings {g.RINGS}, vals array<string>, id bigint, z int, x bigint, y bigint, state int, mx0 double, my0 double, mx1 double, my1 double"
#: What a row is: a tile that was asked for; one below which to look; one that is filled with all below it; and one
#: that was found by looking, which is still to be compared with the feature's box.
FOUND, OPEN, FILLED, BELOW = 0, 1, 2, 3


@dataclass(frozen=True)
class Search:
    zooms: tuple[int, ...]
    #: The clip box's border, in tiles.
    border: float
    #: Tiles to look at, by zoom: first and last column, first and last row.
    ranges: dict[int, tuple[int, int, int, int]]
    candidates: str = "tile"

    @property
    def last(self) -> int:
        return max(self.zooms)


def nested(r: kernels.Rings, features: int) -> pa.Array:
    """Rings as Arrow's nested lists."""
    xy = pa.StructArray.from_arrays([pa.array(r.x.astype(float)), pa.array(r.y.astype(float))], ["x", "y"])
    pts = pa.ListArray.from_arrays(pa.array(r.ring.astype(np.int32)), xy)
    at = np.searchsorted(r.feat, np.arange(features + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(r.ext.astype(bool)), pts], ["ext", "pts"]))


def filled(r: kernels.Rings, box: tuple[np.ndarray, ...], poly: np.ndarray) -> np.ndarray:
    """Which polygons are just their clip box: one ring, on corners alone, that encloses all of it."""
    n = len(poly)
    rings = np.bincount(r.feat, minlength=n)
    f = r.feat[r.of_vertex()]
    corner = ((r.x == box[0][f]) | (r.x == box[2][f])) & ((r.y == box[1][f]) | (r.y == box[3][f]))
    # twice the area, from the first corner so that nothing is lost to rounding
    x, y = (r.x - box[0][f]) / (box[2] - box[0])[f], (r.y - box[1][f]) / (box[3] - box[1])[f]
    area = np.abs(kernels.signed_areas(kernels.Rings(np.round(x), np.round(y), r.ring, r.feat, r.ext)))
    out = np.zeros(n, bool)
    out[r.feat] = (kernels.sums(corner.astype(np.int64), r.ring) == r.sizes) & (area == 2) & (r.sizes == 5)
    return out & poly & (rings == 1)


def children(r: kernels.Rings, z: int, x: np.ndarray, y: np.ndarray, poly: np.ndarray, own: np.ndarray, s: Search) -> tuple[kernels.Rings, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in tiles of zoom z: for each tile below in which a cut leaves something, the rings that it needs, the row it
    comes from, its tile, and whether it is filled. own: boxes of the whole features in Mercator units (4 columns)."""
    n = len(x)
    z, tiles = z + 1, float(1 << z + 1)
    row = np.repeat(np.arange(n), 4)
    cx, cy = 2 * x[row] + np.tile([0, 1, 0, 1], n), 2 * y[row] + np.tile([0, 0, 1, 1], n)
    x0, x1, y0, y1 = s.ranges[z]
    bounds = kernels.bounds(r, n)
    k, eps = s.border, 1e-9
    clip = ((cx - k) / tiles, (cy - k) / tiles, (cx + 1 + k) / tiles, (cy + 1 + k) / tiles)
    ok = (bounds[0][row] <= clip[2]) & (bounds[2][row] >= clip[0]) & (bounds[1][row] <= clip[3]) & (bounds[3][row] >= clip[1])
    pad = k / tiles + eps  # candidates are told exactly later
    ok &= (own[row, 0] <= (cx + 1) / tiles + pad) & (own[row, 2] >= cx / tiles - pad) & (own[row, 1] <= (cy + 1) / tiles + pad) & (own[row, 3] >= cy / tiles - pad)
    ok &= (cx >= x0) & (cx <= x1) & (cy >= y0) & (cy <= y1)
    row, cx, cy = row[ok], cx[ok], cy[ok]
    clip = tuple(c[ok] for c in clip)
    thin = kernels.thinned(kernels.gather(r, row, n), clip)
    cut = kernels.fit(thin, clip, poly[row])
    left = np.flatnonzero(np.bincount(cut.feat, minlength=len(row)) > 0)
    full = filled(cut, clip, poly[row])
    return kernels.gather(thin, left, len(row)), row[left], cx[left], cy[left], full[left]


def with_tiles(b: pa.RecordBatch, rows: np.ndarray, z: int | np.ndarray, x: np.ndarray, y: np.ndarray, state: int, rings: pa.Array | None = None) -> pa.RecordBatch:
    """Rows of a batch with other tiles, and rings if they are others too."""
    take, n = pa.array(rows), len(rows)
    own = {"z": pa.array(np.broadcast_to(z, n).astype(np.int32)), "x": pa.array(x), "y": pa.array(y), "state": pa.array(np.full(n, state, np.int32))}
    if rings is not None:
        own["rings"] = rings
    names = b.schema.names
    return pa.RecordBatch.from_arrays([own[c] if c in own else b.column(c).take(take) for c in names], names=names)


def descend(b: pa.RecordBatch, s: Search, steps: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch that are OPEN, replaced by those below, so many zooms down; others as they are. Depth first,
    ROWS and VERTICES at a time."""
    from tilespark.operators.tiles import flat_rings

    state = b.column("state").to_numpy()
    if (state != OPEN).any():
        yield b.filter(pa.array(state != OPEN))
    b = b.filter(pa.array(state == OPEN))
    if not b.num_rows:
        return
    z, kind = b.column("z").to_numpy(), b.column("geom_type").to_numpy()
    poly = (kind == g.POLYGON) | (kind == g.MULTIPOLYGON)
    x, y = (b.column(c).to_numpy() for c in "xy")
    r = flat_rings(b.column("rings"))
    own = np.stack([b.column(c).to_numpy() for c in MERCATOR], 1)
    todo = [(kernels.gather(r, rows, b.num_rows), int(v), int(v) + steps, x[rows], y[rows], rows) for v in np.unique(z) for rows in [np.flatnonzero(z == v)]]
    while todo:
        rings, v, down_to, tx, ty, source = todo.pop()
        if len(source) > 1 and (len(source) > ROWS or len(rings.x) > VERTICES):
            half = len(source) // 2
            for at in (np.arange(half, len(source)), np.arange(half)):
                todo.append((kernels.gather(rings, at, len(source)), v, down_to, tx[at], ty[at], source[at]))
            continue
        thin, row, cx, cy, full = children(rings, v, tx, ty, poly[source], own[source], s)
        below = source[row]
        v += 1
        for keep, kind_ in ((full, FILLED), (~full, BELOW)):
            if keep.any() and (kind_ == FILLED or v in s.zooms):
                at = np.flatnonzero(keep)
                yield with_tiles(b, below[at], v, cx[at], cy[at], kind_, nested(kernels.gather(thin, at, len(row)), len(at)))
        at = np.flatnonzero(~full)
        if v < s.last and len(at):
            rest = kernels.gather(thin, at, len(row))
            if v < down_to:
                todo.append((rest, v, down_to, cx[at], cy[at], below[at]))
            else:
                yield with_tiles(b, below[at], v, cx[at], cy[at], OPEN, nested(rest, len(at)))


def all_below(b: pa.RecordBatch, s: Search) -> Iterator[pa.RecordBatch]:
    """All tiles of the zooms in, and below, FILLED rows, ROWS at a time."""
    z, x, y = (b.column(c).to_numpy().astype(np.int64) for c in "zxy")
    for v in s.zooms:
        rows = np.flatnonzero(z <= v)
        d = v - z[rows]
        x0, x1, y0, y1 = s.ranges[v]
        lo = np.maximum(x[rows] << d, x0), np.maximum(y[rows] << d, y0)
        wide = np.maximum(np.minimum((x[rows] + 1 << d) - 1, x1) - lo[0] + 1, 0)
        count = wide * np.maximum(np.minimum((y[rows] + 1 << d) - 1, y1) - lo[1] + 1, 0)
        ends = np.cumsum(count)
        for first in range(0, int(ends[-1]) if len(ends) else 0, ROWS):
            k = np.arange(first, min(first + ROWS, int(ends[-1])))
            i = np.searchsorted(ends, k, "right")
            k -= (ends - count)[i]
            yield with_tiles(b, rows[i], v, lo[0][i] + k % wide[i], lo[1][i] + k // wide[i], BELOW)


def candidates_of(b: pa.RecordBatch, s: Search) -> pa.RecordBatch:
    """The rows whose feature's box meets the tile's (or its buffer's); touching counts."""
    x, y = (b.column(c).to_numpy() for c in "xy")
    n = (np.ones(len(x), np.int64) << b.column("z").to_numpy()).astype(float)
    if s.candidates == "tile":
        box = [b.column(c).to_numpy() for c in BOX]
        lat = lambda v: np.degrees(np.arctan(np.sinh(np.pi - 2 * np.pi * v / n)))
        own = (x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y))
    else:
        box, k = [b.column(c).to_numpy() for c in MERCATOR], s.border
        own = ((x - k) / n, (y - k) / n, (x + 1 + k) / n, (y + 1 + k) / n)
    keep = (box[0] <= own[2]) & (box[2] >= own[0]) & (box[1] <= own[3]) & (box[3] >= own[1])
    return b.filter(pa.array(keep))


def expand(b: pa.RecordBatch, s: Search) -> Iterator[pa.RecordBatch]:
    """All tiles of a batch's rows, those below OPEN and FILLED ones too."""
    for out in descend(b, s, s.last):
        state = out.column("state").to_numpy()
        plain, below, full = (out.filter(pa.array(state == k)) for k in (FOUND, BELOW, FILLED))
        if plain.num_rows:
            yield plain
        for some in [below, *(all_below(full, s) if full.num_rows else ())]:
            some = candidates_of(some, s)
            if some.num_rows:
                yield some


def begun(features: DataFrame, zooms: list[int], candidates: str = "tile", buffer: int = 0, extent: int = 1, box: tuple[float, float, float, float] | None = None, span: int = SPAN, step: int = STEP) -> tuple[DataFrame, Search]:
    """Prepared features with tiles of some zooms (of a box in degrees, or all), as rows of SCHEMA of which `expand`
    makes all tiles; where there are many zooms, a part of the way has been gone and its rows have been dealt."""
    every = range(max(zooms) + 1)
    found = [grid._column_range(z, box) for z in every]
    s = Search(tuple(sorted(zooms)), buffer / extent, {z: (r[0], r[2], r[1], r[3]) for z, r in zip(every, found, strict=True)}, candidates)
    own = dict(zip(MERCATOR, (tm.project_x("minx"), tm.project_y("maxy"), tm.project_x("maxx"), tm.project_y("miny")), strict=True))
    ok = (F.col("minx") <= F.col("maxx")) & (F.col("miny") <= F.col("maxy"))  # not so for features without a point
    f = features.where(ok).withColumns(own)
    wide = F.greatest(F.col("mx1") - F.col("mx0"), F.col("my1") - F.col("my0"), F.lit(2.0**-30))
    # the deepest zoom at which the box spans so many tiles; points need no descent
    start = F.when(g.is_point(F.col("geom_type")), F.lit(s.last)).otherwise(F.least(F.greatest(F.floor(F.log2(F.lit(float(span)) / wide)), F.lit(0)), F.lit(s.last)).cast("int"))
    level = lambda z, state: F.struct(F.lit(z).alias("z"), F.lit(state).alias("state"), *(F.lit(v).cast("long").alias(c) for v, c in zip(s.ranges[z], ("x0", "x1", "y0", "y1"), strict=True)))
    levels = F.array(*[level(z, FOUND) for z in s.zooms], *[level(z, OPEN) for z in every[:-1]])
    f = f.withColumn("_start", start)
    f = f.withColumn("_l", F.explode(F.filter(levels, lambda v: F.when(v["state"] == FOUND, v["z"] <= F.col("_start")).otherwise((v["z"] == F.col("_start"))))))
    f = f.withColumns({"z": F.col("_l.z"), "state": F.col("_l.state")})
    n = tm.tiles_across("z").cast("double")
    wider = F.when((F.col("state") == OPEN) | F.lit(candidates == "buffered"), F.lit(s.border)).otherwise(F.lit(0.0))

    def run(low: str, high: str, first: str, last: str) -> Column:
        pad = wider + F.lit(1e-6)
        a, b = F.greatest(F.floor(F.col(low) * n - pad), F.col(f"_l.{first}")), F.least(F.floor(F.col(high) * n + pad), F.col(f"_l.{last}"))
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    f = f.withColumn("x", F.explode(run("mx0", "mx1", "x0", "x1"))).withColumn("y", F.explode(run("my0", "my1", "y0", "y1")))
    exact = (F.col("state") == OPEN) | grid.sure(MERCATOR) | (grid.meets() if candidates == "tile" else grid.meets_buffered())
    rows = grid.with_boxes(f, buffer, extent).where(exact).select(*COLUMNS, "state", *MERCATOR)
    if s.last <= step:
        return rows, s
    below = rows.where(F.col("state") == OPEN).mapInArrow(going_down(s, step), SCHEMA).repartition("fid", "z", "x", "y")
    return rows.where(F.col("state") == FOUND).unionByName(below), s


def tiles_of(features: DataFrame, zooms: list[int], candidates: str = "tile", buffer: int = 0, extent: int = 1, box: tuple[float, float, float, float] | None = None, span: int = SPAN, step: int = STEP) -> DataFrame:
    """Prepared features with the tiles of some zooms (of a box in degrees, or all) that they may appear in, as
    grid.own_tiles gives them, but for tiles that their geometry misses. Rings may lack vertices that the tile
    doesn't need."""
    rows, s = begun(features, zooms, candidates, buffer, extent, box, span, step)
    return grid.with_boxes(rows.mapInArrow(going_down(s, None), SCHEMA).select(*COLUMNS), buffer, extent)


def going_down(s: Search, steps: int | None):
    """So many zooms below each row's own, or to the end."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches):
        for b in batches:
            for out in descend(b, s, steps) if steps is not None else expand(b, s):
                yield out.cast(target)

    return run
