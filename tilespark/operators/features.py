"""Features: the rows that tiles are made of.

A features DataFrame has fid (order within the layer), geom_type, rings, the box minx..maxy in degrees, and
property columns. Builders make one from points, or from a table of vertices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as g

BOX = ("minx", "miny", "maxx", "maxy")
#: Where a feature's bytes are, for sources that know.
PLACE = ("byte_at", "byte_end", "byte_file")
CORE = ("fid", "geom_type", "rings", *BOX, *PLACE)
#: What the builder of points says of the column geom_type.
ONLY_POINTS = {"only": "points"}


def from_points(df: DataFrame, fid: str, lon: str, lat: str) -> DataFrame:
    """One point a row; other columns are properties."""
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    rings = F.array(F.struct(F.lit(True).alias("ext"), F.array(F.struct(x.alias("x"), y.alias("y"))).alias("pts")))
    rest = [c for c in df.columns if c not in (fid, lon, lat)]  # places among them
    return df.select(F.col(fid).cast("long").alias("fid"), F.lit(g.POINT).alias("geom_type", metadata=ONLY_POINTS), rings.alias("rings"), x.alias("minx"), y.alias("miny"), x.alias("maxx"), y.alias("maxy"), *rest)


def from_vertices(df: DataFrame, geom_type: Column | int, ring: str | None = None, ext: str | None = None, vtx: str = "vtx", lon: str = "lon", lat: str = "lat", fid: str = "fid") -> DataFrame:
    """Rings gathered from one row a vertex, in order of ring and vertex. One feature's vertices meet in a
    task, which a feature has to fit anyway."""
    r = F.col(ring) if ring else F.lit(0)
    e = F.col(ext) if ext else r == 0
    pts = df.groupBy(F.col(fid).cast("long").alias("fid"), r.cast("int").alias("ring")).agg(
        F.first(e).alias("ext"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(vtx).alias("v"), F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("pts"),
    )
    rings = pts.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "ext", "pts"))), lambda s: F.struct(s["ext"].alias("ext"), s["pts"].alias("pts"))).alias("rings"))
    kind = geom_type if isinstance(geom_type, Column) else F.lit(geom_type)
    return with_box(rings.select("fid", kind.cast("int").alias("geom_type"), "rings"))


def with_box(df: DataFrame) -> DataFrame:
    """Adds the box, from all vertices, where there is none."""
    if all(c in df.columns for c in BOX):
        return df
    b = g.bounds(g.all_points(F.col("rings")))
    return df.withColumns(b)


def property_columns(df: DataFrame, columns: tuple[str, ...] | None) -> list[tuple[str, str]]:
    """(name, type) of the properties, in order."""
    kinds = dict(df.dtypes)
    return [(c, kinds[c]) for c in (columns if columns is not None else [c for c in df.columns if c not in CORE])]


def only_points(df: DataFrame) -> bool:
    """Whether the builder of these features says so."""
    return df.schema["geom_type"].metadata == ONLY_POINTS


def keys_of(df: DataFrame, columns: tuple[str, ...] | None) -> list[tuple[str, str]]:
    """(name, type) of the properties that tiles carry: binary ones don't."""
    return [(n, t) for n, t in property_columns(df, columns) if t != "binary"]


def prepared(df: DataFrame, columns: tuple[str, ...] | None = None, id_col: str | None = None) -> DataFrame:
    """fid, geom_type, the box, Mercator rings, vals (texts of the properties) and id: all that tiles need, once
    a feature; and its place, if that is known."""
    df = with_box(df)
    vals = g.value_texts(keys_of(df, columns))
    return df.select("fid", "geom_type", *BOX, g.project(F.col("rings")).alias("rings"), vals.alias("vals"), (F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("id"), *[c for c in PLACE if c in df.columns])
