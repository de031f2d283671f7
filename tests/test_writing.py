"""Files written by all tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions import geometry as g
from tilespark.sources import flatgeobuf as fgb


def frame(spark, n):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, y = rng.uniform([-179, -80], [178, 79])
        pts = [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y))]
        kind = (g.POLYGON, g.LINE, g.MULTIPOLYGON)[i % 3]
        rings = [{"ext": True, "pts": pts}] + ([{"ext": True, "pts": pts[::-1]}] if kind == g.MULTIPOLYGON else [])
        rows.append((i, kind, rings, None if i % 5 == 0 else f"n{i} é", i / 7 if i % 4 else None, b"\x00\x01" if i % 2 else None))
    return spark.createDataFrame(rows, f"pk long, geom_type int, rings {g.RINGS}, name string, share double, raw binary")


COLUMNS = [("pk", "long"), ("name", "string"), ("share", "double"), ("raw", "binary")]


@pytest.mark.parametrize(("n", "node_size", "partitions"), [(1, 16, 3), (500, 16, 7), (300, 4, 1), (40, 0, 2)])
def test_files_come_back(spark, tmp_path, n, node_size, partitions):
    df, path = frame(spark, n), str(tmp_path / "a.fgb")
    empty = spark.createDataFrame([(-1, g.POLYGON, [], "gone", None, None)], df.schema)
    fgb.write_frame(df.union(empty).repartition(4), path, COLUMNS, node_size, partitions=partitions)
    back = fgb.read(spark, path)
    key = lambda d: sorted((r["pk"], r["geom_type"], repr(r["rings"]), r["name"], r["share"], r["raw"] and bytes(r["raw"])) for r in d.collect())
    assert key(back) == key(df)
    assert fgb.header_of(path).count == n
    part = "maxx >= -20.5 and minx <= 60 and maxy >= -10 and miny <= 33.25"
    from tilespark.operators.features import with_box

    assert {r["pk"] for r in back.where(part).collect()} == {r["pk"] for r in with_box(df).where(part).collect()}
    if node_size and n > 100:  # near features stand near each other
        at = back.select("fid", F.col("minx"), F.col("miny")).orderBy("fid").toPandas()
        step = np.hypot(np.diff(at["minx"]), np.diff(at["miny"]))
        assert np.median(step) < 30 and list(at["fid"]) == list(range(n))


def test_no_features(spark, tmp_path):
    path = str(tmp_path / "a.fgb")
    fgb.write_frame(frame(spark, 3).where("pk < 0"), path, COLUMNS)
    assert fgb.read(spark, path).count() == 0


def test_hilbert_is_a_walk():
    """Every cell once, each beside the one before."""
    x, y = (a.ravel() for a in np.meshgrid(np.arange(16), np.arange(16)))
    d = fgb.hilbert(x, y, 4)
    assert sorted(d.tolist()) == list(range(256))
    o = np.argsort(d)
    assert (np.abs(np.diff(x[o])) + np.abs(np.diff(y[o])) == 1).all()
