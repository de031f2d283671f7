"""Tiles in pieces: the same bytes as whole tiles, read without holding a tile."""

import hashlib

import numpy as np
import pytest
from test_crowded_tiles import sources

from tilespark import TileEngine
from tilespark.functions import pbf
from tilespark.operators import assembly, grid, tiles
from tilespark.plans import queries


def joined(pieces):
    out = {}
    for r in sorted(pieces.where("ord >= 0").collect(), key=lambda r: tuple(r)[:7]):
        out.setdefault(tuple(r)[:3], []).append(bytes(r["bytes"]))
    return {t: b"".join(v) for t, v in out.items()}


@pytest.fixture(scope="module")
def whole(spark):
    return {tuple(r)[:3]: bytes(r["pbf"]) for r in TileEngine(spark, sources(spark)).pyramid(0, 2).collect()}


@pytest.mark.parametrize("hot", [150, 10**6])
def test_pieces_make_the_tile(spark, monkeypatch, whole, hot):
    monkeypatch.setattr(assembly, "RUN", 100)
    monkeypatch.setattr(assembly, "MOST", 1000)  # no tile is made as one value where it is crowded
    e = TileEngine(spark, sources(spark), hot=hot)
    pieces = e.pyramid_pieces(0, 2).cache()
    assert joined(pieces.unionByName(tiles.heads(pieces, e.named()))) == whole
    if hot == 150:
        zero = pieces.where("z = 0 and ord = 0 and section = 2")
        assert zero.select("run").distinct().count() > 3 and zero.agg({"n": "sum"}).first()[0] == 900
    got = {tuple(r)[:3]: (r["bytes"], r["sha256"]) for r in e.pyramid_digests(0, 2).collect()}
    assert got == {t: (len(b), hashlib.sha256(b).hexdigest()) for t, b in whole.items()}
    sizes = e.sizes(grid.pyramid(spark, 0, 2), few=False, zooms=[0, 1, 2])
    assert {tuple(r)[:3]: r["bytes"] for r in sizes.collect()} == {t: len(b) for t, b in whole.items()}


def test_features_as_arrays(whole):
    for raw in whole.values():
        for lay, (_, layer) in zip(pbf.decode(raw), pbf.Reader(raw).fields(), strict=True):
            own = b"".join(pbf.field(2, v) for k, v in pbf.Reader(layer).fields() if k == 2)
            f = pbf.features(own)
            assert f.id.tolist() == [v["id"] or 0 for v in lay["features"]] and f.kind.tolist() == [v["type"] for v in lay["features"]]
            for flat, at, name in ((f.tags, f.tag_at, "tags"), (f.commands, f.command_at, "commands")):
                assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [v[name] for v in lay["features"]]


def test_paths_as_arrays():
    shapes = [(1, [9, 50, 34]), (1, [17, 10, 14, 3, 9]), (2, [9, 4, 2, 18, 4, 6, 12, 8]), (3, [9, 0, 0, 18, 20, 0, 0, 20, 15, 9, 199, 99, 18, 20, 0, 0, 20, 15])]
    raw = b"".join(pbf.field(2, pbf.feature(b"".join(map(pbf.varint, c)), kind, b"", fid)) for fid, (kind, c) in enumerate(shapes))
    of, size, x, y = pbf.features(raw).paths()
    want = [p[: -1 if kind == 3 else None] for kind, c in shapes for p in pbf.decode_geometry(c)]
    assert np.split(np.stack([x, y], 1), np.cumsum(size)[:-1])[-1].tolist() == list(map(list, want[-1]))
    assert [list(zip(x[a : a + n].tolist(), y[a : a + n].tolist())) for a, n in zip(np.cumsum(size) - size, size)] == want and of.tolist() == [0, 1, 1, 2, 3, 3]
    with pytest.raises(ValueError, match="written here"):
        pbf.features(pbf.field(2, b"\x18\x01\x08\x05"))


def test_no_piece_is_a_whole_tile(spark, monkeypatch):
    """The queries read stretches of a tile, whatever a tile holds."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        pieces = queries.property_tiles(spark, "/root/testdata/sf0.001").where("section = 2").cache()
        assert pieces.agg({"n": "max"}).first()[0] <= 200 and pieces.where("z = 0").agg({"n": "sum"}).first()[0] == 1500
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
