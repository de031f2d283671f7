"""Tiles put together in two levels are the same, to the byte, as those that one task streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark import Options, Source, TileEngine
from tilespark.functions import geometry as g
from tilespark.operators import assembly
from tilespark.operators import features as ft


def sources(spark, n=900):
    base = spark.range(n).select(
        ((F.col("id") * 7919) % 360 - 180).cast("double").alias("lon"), ((F.col("id") * 104729) % 170 - 85).cast("double").alias("lat"), (F.col("id") * 31 % 700).alias("fid"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("v"), F.col("id") % 40)).alias("a"), (F.col("id") % 7).alias("b"), F.when(F.col("id") > 600, F.col("id") / 4).alias("late"), F.lit(None).cast("string").alias("never"),
    )
    pts = ft.from_points(base, "fid", "lon", "lat")
    square = lambda x, y, s: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]
    rng = np.random.default_rng(1)
    polys = spark.createDataFrame([(i, g.POLYGON, [{"ext": True, "pts": square(*rng.uniform(-80, 70, 2), 5.0)}], f"p{i % 3}") for i in range(300)], f"fid long, geom_type int, rings {g.RINGS}, name string")
    return [Source("pts", pts, id_col="fid"), Source("none", pts.where("fid < 0")), Source("polys", polys, Options(min_zoom=1))]


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("empty", [True, False])
def test_two_levels_equal_one(spark, small_batches, monkeypatch, empty):
    monkeypatch.setattr(assembly.assembled, "__defaults__", (100,))
    want = {tuple(r)[:3]: bytes(r["pbf"]) for r in TileEngine(spark, sources(spark)).pyramid(0, 2, empty=empty).collect()}
    e = TileEngine(spark, sources(spark), hot=150)
    crowd = e.crowded([0, 1, 2])
    assert 1 < crowd.count() < len(want)
    got = {tuple(r)[:3]: bytes(r["pbf"]) for r in e.pyramid(0, 2, empty=empty).collect()}
    assert got == want
    assert e.tile(0, 0, 0) == want[0, 0, 0]


def test_nothing_is_crowded(spark):
    assert TileEngine(spark, sources(spark), hot=1000).crowded([0, 1, 2]) is None


def test_too_large_a_tile_raises(spark, monkeypatch):
    monkeypatch.setattr(assembly, "MOST", 1000)
    with pytest.raises(Exception, match="2 GB at most: 0/0/0"):
        TileEngine(spark, sources(spark), hot=150).tile(0, 0, 0)
