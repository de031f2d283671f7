"""Column functions against hand-computed values, and tiles from end to end."""

import http.server
import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark import Options, Source, TileEngine
from tilespark.functions import geometry as g
from tilespark.functions import pbf
from tilespark.functions import tilemath as tm
from tilespark.operators import features as ft
from tilespark.operators import grid
from tilespark.options import DEFAULTS, Behaviour, resolve
from tilespark.sources import flatgeobuf as fgb
from tilespark.sources import ranges


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_projection(spark):
    assert [one(spark, tm.project_x(F.lit(float(v)))) for v in (-180, -90, 0, 90, 180, 190)] == pytest.approx([0, 0.25, 0.5, 0.75, 1, 370 / 360])
    assert [one(spark, tm.project_y(F.lit(float(v)))) for v in (90, -90, 0)] == pytest.approx([0, 1, 0.5])
    assert np.isnan(one(spark, tm.project_y(F.lit(float("nan")))))


def test_tile_numbers(spark):
    assert one(spark, tm.tile_id(F.lit(0), F.lit(0), F.lit(0))) == 0
    assert one(spark, tm.tile_id(F.lit(3), F.lit(5), F.lit(2))) == 675
    b = tm.tile_box(F.lit(0), F.lit(0), F.lit(0))
    assert [one(spark, c) for c in b.values()] == pytest.approx([-180, -85.0511287798, 180, 85.0511287798])
    ids = grid.pyramid(spark, 1, 4).select(tm.tile_id("z", "x", "y").alias("i")).distinct().count()
    assert ids == sum(4**z for z in range(1, 5))
    assert one(spark, tm.quantize(F.lit(0.3), F.lit(2), F.lit(2), F.lit(1000))) == -800
    assert one(spark, tm.sq_tolerance(F.lit(3), F.lit(0), F.lit(4096))) == pytest.approx((3 / 4096) ** 2)
    for bad in ((31, 0, 0), (1, 2, 0), (1, 0, -1)):
        with pytest.raises(ValueError):
            tm.check_tile(*bad)


def pts(*p):
    return F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in p])


def brute_zigzag(n):
    return 2 * n if n >= 0 else -2 * n - 1


def brute_point_commands(points):
    out, x, y = [], 0, 0
    for a, b in points:
        out += [brute_zigzag(a - x), brute_zigzag(b - y)]
        x, y = a, b
    return [1 + 8 * len(points), *out] if points else []


def test_point_commands(spark):
    rng = np.random.default_rng(4)
    numbers = [0, 7, -7, 2**31, -(2**31) - 1, 2**40]
    assert [one(spark, g.zigzag(F.lit(v))) for v in numbers] == [brute_zigzag(v) for v in numbers]
    for n in (1, 2, 9):
        points = [tuple(map(int, p)) for p in rng.integers(-5000, 5000, (n, 2))]
        assert one(spark, g.encode_points(pts(*points))) == brute_point_commands(points)


def test_value_texts(spark):
    df = spark.createDataFrame([(1, -2, 2.0, 2.5, float("nan"), -0.0, True, "s", None, 1e300, b"x"), (None,) * 11], "a int, b bigint, c double, d double, e double, f float, g boolean, h string, i string, j double, k binary")
    got = [r["p"] for r in df.select(g.value_texts(df.dtypes[:-1]).alias("p")).collect()]
    assert [t and t[0] for t in got[0]] == ["u", "i", "u", "d", "d", "u", "b", "s", None, "d"] and got[1] == [None] * 10
    from tilespark.functions.layers import value_message

    read = [pbf.decode_value(value_message(t)) for t in got[0] if t]
    assert read[:4] == [("uint", 1), ("int", -2), ("uint", 2), ("double", 2.5)] and np.isnan(read[4][1]) and read[5:] == [("uint", 0), ("bool", True), ("string", "s"), ("double", 1e300)]


def test_value_kinds(spark):
    df = spark.createDataFrame([(1, -2, 2.0, 2.5, float("nan"), -0.0, True, "s", None, 1e300, b"x")], "a int, b bigint, c double, d double, e double, f float, g boolean, h string, i string, j double, k binary")
    props = df.select(g.tags_of(df.dtypes).alias("p")).first()["p"]
    assert {p["k"]: p["v"]["t"] for p in props} == {"a": "uint", "b": "int", "c": "uint", "d": "double", "e": "double", "f": "uint", "g": "bool", "h": "string", "j": "double"}


def test_options():
    assert resolve(Options(tolerance=11), Options(buffer=33, tolerance=2)) == Options(4096, 33, 11, 24, 0)
    assert resolve(Options(tolerance=0, buffer=0)) == Options(4096, 0, 0, 24, 0)
    assert resolve(None) == DEFAULTS
    with pytest.raises(ValueError):
        Behaviour(winding="left")


def some_features(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    rows = [
        (0, g.POLYGON, [(True, square(-170, -80, 340)), (False, square(-10, -10, 20))], "world"),
        (1, g.LINE, [(True, [(-100.0, 10.0), (0.0, 10.0), (100.0, -10.0)])], "line"),
        (2, g.POINT, [(True, [(10.0, 10.0)])], None),
        (3, g.MULTIPOINT, [(True, [(10.0, 10.0), (-120.0, 40.0)])], "many"),
        (4, g.POINT, [(True, [(0.0, 0.0)])], "corner"),
    ]
    data = [(f, k, [{"ext": e, "pts": [{"x": float(a), "y": float(b)} for a, b in p]} for e, p in rs], n) for f, k, rs, n in rows]
    return spark.createDataFrame(data, f"fid long, geom_type int, rings {g.RINGS}, name string")


def test_tile_from_end_to_end(spark):
    e = TileEngine(spark, [Source("all", some_features(spark)), Source("late", some_features(spark), Options(min_zoom=9))])
    layers = pbf.decode(e.tile(1, 1, 0))
    assert [(lay["name"], len(lay["features"])) for lay in layers] == [("all", 5), ("late", 0)]
    names = [f["properties"].get("name") for f in layers[0]["features"]]
    assert names == ["world", "line", None, "many", "corner"]
    assert len(layers[0]["features"][3]["paths"]) == 1  # one of its points lies elsewhere
    assert layers[0]["features"][4]["paths"] == [[(0, 4096)]]  # a corner belongs to all four tiles


def test_request_equals_pyramid(spark):
    e = TileEngine(spark, Source("all", some_features(spark)))
    got = {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.pyramid(0, 3).collect()}
    assert len(got) == 85
    for t in ((0, 0, 0), (2, 1, 1), (3, 7, 0), (3, 4, 4)):
        assert got[t] == e.tile(*t)
    listed = {(r["z"], r["x"], r["y"]): bytes(r["pbf"]) for r in e.tile_list([(3, 4, 4), (1, 0, 0)]).collect()}
    assert listed[3, 4, 4] == got[3, 4, 4] and listed[1, 0, 0] == got[1, 0, 0]


def test_world_polygon_stays_cheap_at_depth(spark):
    f = ft.with_box(some_features(spark)).where("fid = 0")
    assert grid.cells(f, [20]).count() < 100


def test_layer_structs(spark):
    e = TileEngine(spark, Source("all", some_features(spark)))
    r = e.layer_structs(grid.tiles_frame(spark, [(0, 0, 0)])).first()
    assert r["keys"] == ["name"] and [v["s"] for v in r["values"]] == ["world", "line", "many", "corner"]
    assert [list(t) for t in r["tags"]] == [[0, 0], [0, 1], [], [0, 2], [0, 3]]


def test_tilejson(spark):
    j = TileEngine(spark, [Source("a", some_features(spark), Options(min_zoom=7, max_zoom=13)), Source("b", some_features(spark).where("fid=2"), Options(max_zoom=9))]).tilejson()
    assert (j["minzoom"], j["maxzoom"], j["tilejson"]) == (0, 13, "3.0.0")
    assert j["bounds"] == pytest.approx([-170, -80, 170, 260])
    assert j["vector_layers"][0] == {"id": "a", "fields": {"name": "String"}, "minzoom": 7, "maxzoom": 13}
    assert TileEngine(spark, []).tilejson()["bounds"] == [-180, -85.0511, 180, 85.0511]
    with pytest.raises(ValueError):
        TileEngine(spark, [Source("a", None), Source("a", None)])


def test_empty_source(spark):
    e = TileEngine(spark, Source("none", some_features(spark).where("false")))
    assert pbf.decode(e.tile(0, 0, 0))[0]["features"] == []


def test_ranges():
    assert ranges.merge([(0, 10), (500, 10), (2000, 5)]) == [(0, 510), (2000, 5)]
    assert ranges.s3_location("s3://b/k/x") == ranges.s3_location("b/k/x") == ("b", "k/x")
    with pytest.raises(ValueError):
        ranges.s3_location("b")


class Handler(http.server.BaseHTTPRequestHandler):
    data, failures = bytes(range(256)) * 4, [2]

    def do_GET(self):
        if self.failures[0]:
            self.failures[0] -= 1
            self.send_response(503)
            self.end_headers()
            return
        a, b = self.headers["Range"].removeprefix("bytes=").split("-")
        body = self.data[int(a) : int(b) + 1 if b else None]
        self.send_response(206)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


def test_http_reader():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    r = ranges.HttpReader(backoff=0.01)
    url = f"http://127.0.0.1:{server.server_port}/x"
    assert r.read(url, 3, 4) == bytes([3, 4, 5, 6])
    assert r.read_ranges(url, [(i, 2) for i in range(20)]) == [bytes([i, i + 1]) for i in range(20)]
    server.shutdown()


class FakeStore:
    def __init__(self, kind):
        self.kind = kind

    def get_object(self, Bucket, Key, Range):
        a, b = Range.removeprefix("bytes=").split("-")
        raw = bytes(range(256))[int(a) : int(b) + 1]
        return {"Body": raw if self.kind == "bytes" else iter([raw[:1], raw[1:]])}


@pytest.mark.parametrize("kind", ["bytes", "iterable"])
def test_s3_reader(kind):
    assert ranges.S3Reader(FakeStore(kind)).read_ranges("s3://b/k", [(5, 3), (0, 2)]) == [b"\x05\x06\x07", b"\x00\x01"]


COLUMNS = [("i8", "byte"), ("u8", "ubyte"), ("b", "bool"), ("i16", "short"), ("u16", "ushort"), ("i32", "int"), ("u32", "uint"), ("i64", "long"), ("u64", "ulong"), ("f", "float"), ("d", "double"), ("s", "string"), ("j", "json"), ("t", "datetime"), ("x", "binary")]
PROPS = {"i8": -5, "u8": 200, "b": True, "i16": -300, "u16": 60000, "i32": -70000, "u32": 4_000_000_000, "i64": -(1 << 60), "u64": (1 << 64) - 1, "f": 1.5, "d": 2.25, "s": "é", "j": "{}", "t": "2020-01-01", "x": b"\x01\x02"}


def file_of(path, n, node_size=16, single_root=True):
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        x, y = float(rng.integers(-170, 170)), float(rng.integers(-80, 80))
        square = np.array([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)])
        rings = [(True, square), (False, square * 0.5 + np.array([x, y]) * 0.5), (True, square + 3)][: 1 + i % 3]
        rows.append((g.MULTIPOLYGON if i % 3 == 2 else g.POLYGON, rings, PROPS if i % 2 == 0 else {"s": str(i)}))
    fgb.write(str(path), rows, COLUMNS, node_size, single_root=single_root)
    return rows


@pytest.mark.parametrize("n,node_size,single_root", [(1, 16, True), (1, 16, False), (40, 4, True), (300, 16, True), (7, 0, True)])
def test_flatgeobuf_roundtrip(spark, tmp_path, n, node_size, single_root):
    rows = file_of(tmp_path / "a.fgb", n, node_size, single_root)
    df = fgb.read(spark, str(tmp_path / "a.fgb"), single_root=str(single_root).lower())
    got = df.orderBy("fid").collect()
    assert len(got) == n
    for r, (kind, rings, props) in zip(got, rows, strict=True):
        assert r["geom_type"] == kind
        assert [(q["ext"], [tuple(p) for p in q["pts"]]) for q in r["rings"]] == [(e, [tuple(v) for v in p]) for e, p in rings]
        assert {k: r[k] for k in props} == props
    inside = df.where("maxx >= -20 and minx <= 30 and maxy >= -10 and miny <= 40")
    want = [i for i, (_, rings, _) in enumerate(rows) if (p := np.concatenate([q for _, q in rings])) is not None and p[:, 0].max() >= -20 and p[:, 0].min() <= 30 and p[:, 1].max() >= -10 and p[:, 1].min() <= 40]
    assert sorted(r["fid"] for r in inside.collect()) == want
    if node_size == 0:
        assert fgb.read(spark, str(tmp_path / "a.fgb"), strict_index=True).count() == 0


def test_flatgeobuf_errors(spark, tmp_path):
    (tmp_path / "bad").write_bytes(b"nonsense, not a file")
    with pytest.raises(Exception, match="FlatGeobuf"):
        fgb.read_header(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        fgb.levels(5, 1)
    file_of(tmp_path / "cut.fgb", 20)
    raw = (tmp_path / "cut.fgb").read_bytes()
    (tmp_path / "cut.fgb").write_bytes(raw[:-10])
    assert fgb.read(spark, str(tmp_path / "cut.fgb")).count() == 19  # the last feature is cut short


def test_tiles_from_a_file(spark, tmp_path):
    file_of(tmp_path / "t.fgb", 60)
    e = TileEngine(spark, Source("f", str(tmp_path / "t.fgb"), Options(tolerance=0)))
    same = TileEngine(spark, Source("f", fgb.read(spark, str(tmp_path / "t.fgb")), Options(tolerance=0)))
    assert e.tile(1, 0, 0) == same.tile(1, 0, 0) and pbf.decode(e.tile(1, 0, 0))[0]["features"]
    assert json.loads(json.dumps(e.tilejson()))["vector_layers"][0]["fields"]["i64"] == "Number"
    e.close()
    assert e.tile(0, 0, 0)


def test_catalogue_equals_sql(spark):
    """A few queries of the catalogue against DuckDB on the smallest tables; the driver compares all."""
    duckdb = pytest.importorskip("duckdb")
    import os

    from tilespark.plans.queries import ORACLE, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{d}/{t}'")
    for name in ("quantize_points", "clip_polygon_box", "clip_lines_box", "simplify_lines_z6", "encode_polygon_commands", "tile_cover_join_polys_cells", "mvt_roundtrip_points", "streaming_tile_density"):
        a, b = QUERIES[name](spark, d).toPandas(), con.execute(ORACLE[name]).df()
        cols = sorted(a.columns)
        key = lambda df: sorted(tuple(str(float(v)) if isinstance(v, int | float | np.number) else str(v) for v in r) for r in df[cols].itertuples(index=False))  # noqa: E731, B023
        assert key(a) == key(b), name


def test_tile_files(spark, tmp_path):
    from tilespark.sources import tilefiles

    tilefiles.register(spark)
    e = TileEngine(spark, Source("all", some_features(spark)))
    e.pyramid(0, 1).select("z", "x", "y", "pbf").write.format("tilefiles").mode("append").option("path", str(tmp_path / "t")).save()
    found = sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*.pbf"))
    assert found == ["0/0/0.pbf", "1/0/0.pbf", "1/0/1.pbf", "1/1/0.pbf", "1/1/1.pbf"]
    assert (tmp_path / "t/1/1/0.pbf").read_bytes() == e.tile(1, 1, 0)
