"""Tiles by quad-tree descent: the same as by the feature's box, but for tiles that the geometry misses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark import Behaviour, Options, Source, TileEngine
from tilespark.functions import geometry as g
from tilespark.operators import descent, grid, tiles
from tilespark.operators import features as ft


def frame(spark, rows):
    data = [(f, k, [{"ext": e, "pts": [{"x": float(a), "y": float(b)} for a, b in p]} for e, p in rs], f"n{f}") for f, k, rs in rows]
    return spark.createDataFrame(data, f"fid long, geom_type int, rings {g.RINGS}, name string")


def shapes(seed, n):
    """Stars with holes, several parts, zigzag lines and points, from a tile's width to the whole world."""
    rng = np.random.default_rng(seed)
    rows = []
    for f in range(n):
        size = 180 / 2 ** rng.integers(0, 9)
        at = rng.uniform([-170, -70], [170, 70])

        def ring(scale, m):
            a = np.sort(rng.uniform(0, 2 * np.pi, m))
            p = at + scale * rng.uniform(0.4, 1, (m, 1)) * np.stack([np.cos(a), 0.5 * np.sin(a)], 1)
            return [*map(tuple, p), tuple(p[0])]

        kind = int(rng.choice([g.POLYGON, g.POLYGON, g.MULTIPOLYGON, g.LINE, g.MULTILINE, g.MULTIPOINT]))
        if kind == g.POLYGON:
            rings = [(True, ring(size, int(rng.integers(3, 12)))), (False, ring(size / 4, 4))]
        elif kind == g.MULTIPOLYGON:
            rings = [(True, ring(size, 7)), (False, ring(size / 5, 4)), (True, ring(size, 5))]
        else:
            rings = [(True, [tuple(at + size * rng.uniform(-1, 1, 2)) for _ in range(int(rng.integers(1 if kind == g.MULTIPOINT else 2, 8)))]) for _ in range(1 if kind == g.LINE else 2)]
        rows.append((f, kind, rings))
    return [*rows, (n, g.POLYGON, []), (n + 1, g.POLYGON, [(True, [(-180, -85), (180, -85), (180, 85), (-180, 85), (-180, -85)])])]


def encoded(pairs, o):
    return sorted((r["z"], r["x"], r["y"], r["fid"], r["kind"], tuple(r["cmds"]), bytes(r["geom"])) for r in tiles.encoded(pairs, o).collect())


@pytest.mark.parametrize(("seed", "candidates", "buffer", "tolerance", "box", "step"), [(1, "tile", 64, 0, None, 5), (2, "buffered", 64, 3, None, 2), (3, "tile", 0, 0, None, 2), (4, "tile", 300, 3, (-30.0, -20.0, 60.0, 45.0), 3)])
def test_equals_listing_by_box(spark, seed, candidates, buffer, tolerance, box, step):
    f = ft.prepared(frame(spark, shapes(seed, 25)))
    zooms = [0, 2, 3, 5, 6]
    o = Options(4096, buffer, tolerance, 24, 0)
    listed = grid.own_tiles(f, zooms, candidates, buffer, 4096, box)
    found = descent.tiles_of(f, zooms, candidates, buffer, 4096, box, step=step)
    assert found.count() < listed.count()
    assert encoded(found, o) == encoded(listed, o)


def test_small_batches_are_the_same(spark, monkeypatch):
    f = ft.prepared(frame(spark, shapes(7, 12)))
    o = Options(4096, 64, 0, 24, 0)
    s = descent.Search((0, 3, 4, 5), 64 / 4096, {z: (0, (1 << z) - 1, 0, (1 << z) - 1) for z in range(6)})
    want = encoded(descent.tiles_of(f, [0, 3, 4, 5], "tile", 64, 4096), o)
    monkeypatch.setattr(descent, "ROWS", 2)
    assert encoded(descent.tiles_of(f, [0, 3, 4, 5], "tile", 64, 4096, span=1, step=1), o) == want and s.last == 5


def test_diagonal_line_makes_rows_in_proportion(spark):
    f = ft.prepared(frame(spark, [(1, g.LINE, [(True, [(-150.0, -60.0), (150.0, 60.0)])])]))
    assert descent.tiles_of(f, [12], "tile", 64, 4096).count() < 4 * 2**12  # its box covers millions


def test_edges_shared_at_depth(spark):
    """A feature that touches the edge of tiles belongs to those on both sides, also at zoom 22."""
    n = 1 << 22
    x = 1234567 / n * 360 - 180
    f = ft.prepared(frame(spark, [(1, g.LINE, [(True, [(x, 10.0), (x, 10.0001)])])]))
    got = {r["x"] for r in descent.tiles_of(f, [22], "tile", 64, 4096).select("x").distinct().collect()}
    assert got == {1234566, 1234567} == {r["x"] for r in grid.own_tiles(f, [22], "tile", 64, 4096).select("x").distinct().collect()}


def test_filled_tiles_are_named_at_once(spark):
    f = ft.prepared(frame(spark, [(1, g.POLYGON, [(True, [(-179.0, -80.0), (179.0, -80.0), (179.0, 80.0), (-179.0, 80.0), (-179.0, -80.0)])])]))
    assert descent.tiles_of(f, [8], "tile", 64, 4096).count() == grid.own_tiles(f, [8], "tile", 64, 4096).count() > 50_000
    e = TileEngine(spark, Source("w", frame(spark, [(1, g.POLYGON, [(True, [(-179.0, -80.0), (179.0, -80.0), (179.0, 80.0), (-179.0, 80.0), (-179.0, -80.0)])])])), behaviour=Behaviour())
    got = e.pyramid(6, 6, empty=False).where("x = 30 and y = 30").first()
    assert bytes(got["pbf"]) == e.tile(6, 30, 30)


def test_filled_is_exact():
    from tilespark.functions.kernels import Rings

    box = tuple(np.array([v] * 3) for v in (0.25, 0.25, 0.5, 0.5))
    square = [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.5), (0.25, 0.25)]
    bow = [(0.25, 0.25), (0.5, 0.5), (0.5, 0.25), (0.25, 0.5), (0.25, 0.25)]
    part = [(0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.25), (0.25, 0.25)]
    v = np.array([*square, *bow, *part])
    r = Rings(v[:, 0], v[:, 1], np.arange(4) * 5, np.arange(3), np.ones(3, bool))
    assert descent.filled(r, box, np.array([True] * 3)).tolist() == [True, False, False]
    assert not descent.filled(r, box, np.array([False] * 3)).any()


def test_no_features(spark):
    f = ft.prepared(frame(spark, [(1, g.POLYGON, [])]).where(F.lit(False)))
    assert descent.tiles_of(f, [0, 9], "tile", 64, 4096).count() == 0


def test_unknown_types_are_points(spark):
    """Cut and simplified as lines, and written as one command over all vertices."""
    from tilespark.functions import pbf

    rows = [(1, 0, [(True, [(-100.0, 10.0), (0.0, 10.0), (100.0, -10.0)]), (True, [(20.0, 20.0), (30.0, 5.0)])]), (2, 9, [(True, [(10.0, 10.0)])]), (3, g.LINE, [(True, [(-100.0, 10.0), (100.0, -10.0)])])]
    feats = pbf.decode(TileEngine(spark, Source("s", frame(spark, rows), Options(tolerance=0))).tile(0, 0, 0))[0]["features"]
    first, line = feats[0], feats[-1]
    assert first["type"] == 1 and first["commands"][0] == 1 + 8 * 5 and len(first["commands"]) == 11
    assert line["type"] == 2 and len(feats) == 3 and feats[1]["type"] == 1 and feats[1]["commands"][0] == 9
