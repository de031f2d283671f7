"""What is read of a file, and through which reader."""

import http.server
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark import Options, Source, TileEngine
from tilespark.functions import geometry as g
from tilespark.functions import pbf
from tilespark.operators import grid
from tilespark.sources import flatgeobuf as fgb
from tilespark.sources import filesystems, ranges


def points_file(path, n=4000, node_size=16):
    rng = np.random.default_rng(7)
    xy = np.stack([rng.uniform(-179, 179, n), rng.uniform(-80, 80, n)], 1)
    xy = xy[np.lexsort((xy[:, 1], np.floor(xy[:, 0] / 10)))]  # near points stand near each other
    fgb.write(str(path), [(g.POINT, [(True, p[None])], {"name": "x" * 200}) for p in xy], [("name", "string")], node_size)
    return xy


def Counting(log):  # noqa: N802 - a class of its own each time, so that it travels to the tasks
    class Counting(filesystems.FileSystemReader):
        """Writes down how much it reads."""

        def read(self, path, offset, length):
            raw = super().read(path.removeprefix("told://"), offset, length)
            with open(log, "a") as f:
                f.write(f"{len(raw)}\n")
            return raw

    return Counting()


def counted(log):
    return sum(map(int, open(log))) if os.path.exists(log) else 0


def test_a_tile_reads_what_its_box_meets(spark, tmp_path):
    xy = points_file(tmp_path / "p.fgb")
    log, size = str(tmp_path / "log"), os.path.getsize(tmp_path / "p.fgb")
    e = TileEngine(spark, Source("p", str(tmp_path / "p.fgb"), reading={"connector": Counting(log)}))
    index = fgb.header_of(str(tmp_path / "p.fgb")).features_at
    tile = (5, 17, 12)
    box = grid.degrees_of([tile])
    raw = e.tile(*tile)
    want = int(((xy[:, 0] >= box[0]) & (xy[:, 0] <= box[2]) & (xy[:, 1] >= box[1]) & (xy[:, 1] <= box[3])).sum())
    assert len(pbf.decode(raw)[0]["features"]) == want > 0
    assert counted(log) - index < 0.1 * (size - index)  # header and index, and few of the features


def test_metadata_reads_the_header_once(spark, tmp_path):
    xy = points_file(tmp_path / "p.fgb")
    log = str(tmp_path / "log")
    e = TileEngine(spark, Source("p", str(tmp_path / "p.fgb"), reading={"connector": Counting(log)}))
    j = e.tilejson()
    assert j["bounds"] == pytest.approx([*xy.min(0), *xy.max(0)]) and j["vector_layers"][0]["fields"] == {"name": "String"}
    first = counted(log)
    assert first < 2000 and e.tilejson() == j and counted(log) == first
    e.close()
    e.tilejson()
    assert counted(log) == 2 * first


def test_registered_schemes_and_unknown_ones(spark, tmp_path):
    points_file(tmp_path / "p.fgb", 50)
    log = str(tmp_path / "log")
    reader = Counting(log)
    ranges.register_reader("told", lambda: reader)
    assert fgb.read(spark, f"told://{tmp_path}/p.fgb").count() == 50 and counted(log) > 0
    with pytest.raises(ValueError, match="no reader"):
        ranges.reader_for("nowhere://x/y")
    with pytest.raises(ValueError, match="bucket and key"):
        ranges.reader_for("s3://b/k", {"region": "eu-north-1"}).read("s3://b", 0, 1)


def Store(top):  # noqa: N802
    class Store:
        """An S3 client over a folder."""

        def get_object(self, Bucket, Key, Range):
            a, b = Range.removeprefix("bytes=").split("-")
            with open(f"{top}/{Bucket}/{Key}", "rb") as f:
                f.seek(int(a))
                return {"Body": f.read(int(b) - int(a) + 1 if b else -1)}

    return Store()


def test_tiles_from_an_object_store(spark, tmp_path):
    (tmp_path / "b").mkdir()
    points_file(tmp_path / "b/p.fgb", 300)
    e = TileEngine(spark, Source("p", "s3://b/p.fgb", Options(tolerance=0), reading={"connector": ranges.S3Reader(Store(str(tmp_path)))}))
    same = TileEngine(spark, Source("p", str(tmp_path / "b/p.fgb"), Options(tolerance=0)))
    assert e.tile(1, 0, 0) == same.tile(1, 0, 0)


def test_http_options_reach_the_tasks(spark, tmp_path):
    points_file(tmp_path / "p.fgb", 300)
    data = (tmp_path / "p.fgb").read_bytes()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.headers.get("X-Key") != "secret":
                self.send_response(403)
                self.end_headers()
                return
            a, b = self.headers["Range"].removeprefix("bytes=").split("-")
            body = data[int(a) : int(b) + 1 if b else None]
            self.send_response(206)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/p.fgb"
    assert fgb.read(spark, url, headers={"X-Key": "secret"}, retries=1, timeout=5).count() == 300
    with pytest.raises(Exception, match="403"):
        fgb.read(spark, url, retries=0)
    server.shutdown()


@pytest.mark.parametrize("node_size", [16, 0])
def test_max_features(spark, tmp_path, node_size):
    points_file(tmp_path / "p.fgb", 100, node_size)
    assert [r["fid"] for r in fgb.read(spark, str(tmp_path / "p.fgb"), max_features=7).select("fid").orderBy("fid").collect()] == list(range(7))


def test_pyramid_of_the_tiles_with_features(spark):
    f = spark.createDataFrame([(i, -60.0 + i, 10.0 + i / 7, "p") for i in range(40)], "fid long, lon double, lat double, name string")
    from tilespark.operators.features import from_points

    e = TileEngine(spark, Source("p", from_points(f, "fid", "lon", "lat")))
    every = {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.pyramid(0, 4).collect()}
    full = {t: raw for t, raw in every.items() if pbf.decode(raw)[0]["features"]}
    assert {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.pyramid(0, 4, empty=False).collect()} == full and len(full) < len(every) == 341
    box = (-55.0, 9.0, -40.0, 12.5)
    part = {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.pyramid(2, 4, box).collect()}
    assert part and all(every[t] == raw for t, raw in part.items())
    assert e.pyramid(14, 14, empty=False).select(F.sum(F.lit(1))).first()[0] >= 40


def test_a_tile_of_a_large_file_reads_little(spark, tmp_path):
    """Of a file with a million features (a copied index over few distinct ones would do, too) only the nodes that are
    met are read, and tasks are told two numbers each."""
    import pickle
    import struct

    n, node = 1_000_000, 16
    lv = fgb.levels(n, node)
    fgb.write(str(tmp_path / "one.fgb"), [(g.POINT, [(True, np.array([[0.0, 0.0]]))], {"name": "x"})] * 2, [("name", "string")])
    h = fgb.header_of(str(tmp_path / "one.fgb"))
    raw = (tmp_path / "one.fgb").read_bytes()
    size = (len(raw) - h.features_at) // 2
    one = raw[h.features_at : h.features_at + size]
    side = 1000
    gx, gy = np.arange(n) // side * 0.3 - 150, np.arange(n) % side * 0.15 - 75
    nodes = np.zeros(lv[0][1], fgb.NODE)
    lo, hi = lv[0]
    nodes["minx"][lo:hi] = nodes["maxx"][lo:hi] = gx
    nodes["miny"][lo:hi] = nodes["maxy"][lo:hi] = gy
    nodes["offset"][lo:hi] = np.arange(n) * size
    for (clo, chi), (plo, phi) in zip(lv, lv[1:], strict=False):
        first = clo + np.arange(phi - plo) * node
        nodes["offset"][plo:phi] = first
        for c, f in (("minx", np.minimum), ("miny", np.minimum), ("maxx", np.maximum), ("maxy", np.maximum)):
            nodes[c][plo:phi] = f.reduceat(nodes[c][clo:chi], first - clo)
    b = fgb.Builder()
    head = b.finish(b.table({fgb.HEADER_TYPE: ("B", 1), fgb.HEADER_COUNT: ("Q", n), fgb.HEADER_NODE: ("H", node), fgb.HEADER_COLUMNS: ("ref", lambda: b.tables([lambda: b.table({0: ("ref", lambda: b.vector(b"name", True)), 1: ("B", 11)})]))}))
    (tmp_path / "many.fgb").write_bytes(fgb.MAGIC + b"\0" + struct.pack("<I", len(head)) + head + nodes.tobytes() + one * n)
    log = str(tmp_path / "log")
    box = (10.0, 10.0, 10.5, 10.5)
    df = fgb.read(spark, str(tmp_path / "many.fgb"), connector=Counting(log), layout=True).where(f"maxx >= {box[0]} and minx <= {box[2]} and maxy >= {box[1]} and miny <= {box[3]}")
    want = np.flatnonzero((gx >= box[0]) & (gx <= box[2]) & (gy >= box[1]) & (gy <= box[3]))
    got = {r["fid"]: r["byte_at"] for r in df.select("fid", "byte_at").collect()}
    at = fgb.header_of(str(tmp_path / "many.fgb")).features_at
    assert got == {int(i): at + int(i) * size for i in want} and len(want) > 3
    assert counted(log) < 100_000
    r = fgb.Reader(None, {"path": str(tmp_path / "many.fgb")})
    parts = r.partitions()
    assert len(parts) > 50 and max(len(pickle.dumps(p)) for p in parts) < 200


def test_candidates_by_layout_of_a_file(spark, tmp_path):
    """Features between a tile's own in the file come along, and show where they lie in the buffer."""
    from tilespark.options import Behaviour

    # beside the eastern edge of tile (1, 0, 0): within, in the buffer, within, far away
    xs = [-10.0, 0.5, -20.0, 100.0]
    fgb.write(str(tmp_path / "p.fgb"), [(g.POINT, [(True, np.array([[x, 40.0]]))], {"name": f"{x}"}) for x in xs], [("name", "string")])
    names = lambda b: [f["properties"]["name"] for f in pbf.decode(TileEngine(spark, Source("p", str(tmp_path / "p.fgb"), Options(tolerance=0)), behaviour=b).tile(1, 0, 0))[0]["features"]]
    assert names(Behaviour()) == ["-10.0", "-20.0"]
    assert names(Behaviour(candidates="fgb_layout")) == ["-10.0", "0.5", "-20.0"]


def test_scan_without_index_goes_by_steps(spark, tmp_path, monkeypatch):
    points_file(tmp_path / "p.fgb", 300, 0)
    r = fgb.Reader(None, {"path": str(tmp_path / "p.fgb")})
    steps = [x[0] for x in r.scanned(filesystems.FileSystemReader(), step=100)]
    assert steps == list(range(300))


def test_queries_of_one_source_dont_narrow_each_other(spark, tmp_path):
    xy = points_file(tmp_path / "p.fgb", 500)
    e = TileEngine(spark, Source("p", str(tmp_path / "p.fgb"), Options(tolerance=0)))
    one = e.tile(4, 3, 5)
    whole = {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.pyramid(4, 4).collect()}
    assert whole[4, 3, 5] == one and sum(len(pbf.decode(b)[0]["features"]) for b in whole.values()) >= 500
    df = fgb.read(spark, str(tmp_path / "p.fgb"))
    assert df.where("minx <= 0").count() == (xy[:, 0] <= 0).sum() and df.count() == 500 and df.select("fid").distinct().count() == 500
