"""Geometry as column expressions over rings: array<struct<ext: boolean, pts: array<struct<x, y>>>>.

Higher-order functions keep these steps in the JVM. Points go through them from projection to commands; lines
and polygons are projected here and go on in the array kernels.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions import tilemath as tm

#: Geometry types of features, and the three of tiles.
UNKNOWN, POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = range(7)
TILE_POINT, TILE_LINE, TILE_POLYGON = 1, 2, 3
MOVE_TO, LINE_TO, CLOSE_PATH = 1, 2, 7

PTS = "array<struct<x:double,y:double>>"
RINGS = f"array<struct<ext:boolean,pts:{PTS}>>"


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_point(t: Column) -> Column:
    return t.isin(POINT, MULTIPOINT)


def is_polygon(t: Column) -> Column:
    return t.isin(POLYGON, MULTIPOLYGON)


def tile_type(t: Column) -> Column:
    """Geometry type in the tile; unknown ones count as points."""
    return F.when(t.isin(LINE, MULTILINE), TILE_LINE).when(is_polygon(t), TILE_POLYGON).otherwise(TILE_POINT)


def all_points(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: r["pts"]))


def project(rings: Column) -> Column:
    """Degrees to Mercator units."""
    point = lambda p: F.struct(tm.project_x(p["x"]).alias("x"), tm.project_y(p["y"]).alias("y"))
    return F.transform(rings, lambda r: F.struct(r["ext"].alias("ext"), F.transform(r["pts"], point).alias("pts")))


def bounds(pts: Column) -> dict[str, Column]:
    """Least and greatest coordinates; NaN doesn't count, no point gives null."""
    xs, ys = F.filter(F.transform(pts, lambda p: p["x"]), lambda v: ~F.isnan(v)), F.filter(F.transform(pts, lambda p: p["y"]), lambda v: ~F.isnan(v))
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def clip_points(pts: Column, box: dict[str, Column]) -> Column:
    """Points within the box, edges included."""
    return F.filter(pts, lambda p: (p["x"] >= box["c_minx"]) & (p["x"] <= box["c_maxx"]) & (p["y"] >= box["c_miny"]) & (p["y"] <= box["c_maxy"]))


def zigzag(n) -> Column:
    n = tm._c(n).cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def command(kind: int, count) -> Column:
    return F.lit(kind & 7).cast("long").bitwiseOR(F.shiftleft(tm._c(count).cast("long"), 3))


def _deltas(pts: Column, start: Column) -> Column:
    """x and y of each point as zigzag differences from the point before; start is before the first."""
    before = F.concat(F.array(start), F.slice(pts, F.lit(1), F.size(pts) - 1))
    return F.flatten(F.zip_with(pts, before, lambda p, q: F.array(zigzag(p["x"] - q["x"]), zigzag(p["y"] - q["y"]))))


def _origin() -> Column:
    zero = F.lit(0).cast("long")
    return F.struct(zero.alias("x"), zero.alias("y"))


def encode_points(pts: Column) -> Column:
    """All points of a feature under one MoveTo."""
    none = F.array().cast("array<bigint>")
    return let(pts, lambda p: F.when(F.size(p) > 0, F.concat(F.array(command(MOVE_TO, F.size(p))), _deltas(p, _origin()))).otherwise(none))


def tagged(value: Column, dtype: str) -> Column:
    """A property value with its kind in the tile: string, bool, uint, int or double. Whole numbers, also
    those of floating types, are uint from 0 on and int below."""
    empty = {"t": "string", "s": "string", "d": "double", "i": "bigint", "b": "boolean"}
    make = lambda t, **v: F.struct(F.lit(t).alias("t"), *(v.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in empty.items() if k != "t"))
    if dtype == "boolean":
        out = make("bool", b=value)
    elif dtype in ("tinyint", "smallint", "int", "bigint") or dtype.startswith("decimal"):
        v = value.cast("decimal(38,18)") if dtype.startswith("decimal") else value
        whole = v == F.floor(v) if dtype.startswith("decimal") else F.lit(True)
        fits = v.between(-(1 << 63), (1 << 63) - 1) if dtype.startswith("decimal") else F.lit(True)
        i = F.when(whole & fits, v).cast("bigint")
        out = F.when(whole & fits & (v >= 0), make("uint", i=i)).when(whole & fits, make("int", i=i)).otherwise(make("double", d=value.cast("double")))
    elif dtype in ("float", "double"):
        v = value.cast("double")
        # doubles beyond the 64-bit range are whole, but no integer of the tile can hold them
        whole = ~F.isnan(v) & (F.abs(v) < 9.2e18) & (v == F.rint(v))
        i = F.when(whole, v).cast("bigint")
        out = F.when(whole & (v >= 0), make("uint", i=i)).when(whole, make("int", i=i)).otherwise(make("double", d=v))
    else:
        out = make("string", s=value.cast("string"))
    return F.when(value.isNotNull(), out)


def tags_of(columns: list[tuple[str, str]]) -> Column:
    """array<struct<k, v>> of the given (name, type) columns in order, without nulls and binary values."""
    kept = [F.struct(F.lit(n).alias("k"), tagged(F.col(f"`{n}`"), t).alias("v")) for n, t in columns if t != "binary"]
    if not kept:
        return F.array().cast("array<struct<k:string,v:struct<t:string,s:string,d:double,i:bigint,b:boolean>>>")
    return F.filter(F.array(*kept), lambda e: e["v"].isNotNull())


def value_text(value: Column, dtype: str) -> Column:
    """A property value as a text: the first letter of its kind in the tile, then the value."""
    if dtype == "boolean":
        return F.when(value, "b1").when(~value, "b0")
    v = tagged(value, dtype)
    if dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.concat(F.when(value >= 0, "u").otherwise("i"), value.cast("string"))
    if dtype in ("float", "double") or dtype.startswith("decimal"):
        return let(v, lambda t: F.concat(F.substring(t["t"], 1, 1), F.coalesce(t["i"].cast("string"), t["d"].cast("string"))))
    return F.concat(F.lit("s"), value.cast("string"))


def value_texts(columns: list[tuple[str, str]]) -> Column:
    """array<string>: the texts of the given (name, type) columns in order, null where there is no value."""
    return F.array(*[value_text(F.col(f"`{n}`"), t) for n, t in columns]) if columns else F.array().cast("array<string>")
