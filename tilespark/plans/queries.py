"""The catalogue: one query for each operator of the engine, and the same in SQL where SQL can say it.

Queries over features, vertices and ranges take whole tables, and all tiles of the grid of zooms 0 to 3 where it
isn't said otherwise. Doubles are rounded to 9 places, as transcendental functions differ between engines in the
last one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tilespark.functions import geometry as g
from tilespark.functions import kernels, pbf
from tilespark.functions import tilemath as tm
from tilespark.operators import features as ft
from tilespark.operators import grid, tiles
from tilespark.operators.tiles import flat_rings
from tilespark.options import Behaviour, Options, Source, resolved
from tilespark.plans import fixtures as fx
from tilespark.plans.engine import TileEngine, type_label
from tilespark.sources import flatgeobuf, ranges
from tilespark.sources.shared import local_scratch, stored

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def points(spark: SparkSession, d: str) -> DataFrame:
    return ft.from_points(fx.view(spark, d, fx.POINTS), "fid", "lon", "lat")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return ft.from_vertices(fx.view(spark, d, fx.LINES), g.LINE)


def polys(spark: SparkSession, d: str) -> DataFrame:
    df = fx.view(spark, d, fx.POLYS)
    made = ft.from_vertices(df, g.POLYGON, "ring", "ext")
    exteriors = F.size(F.filter("rings", lambda r: r["ext"]))
    return made.withColumn("geom_type", F.when(exteriors > 1, g.MULTIPOLYGON).otherwise(g.POLYGON))


LAYERS = {"points": points, "lines": lines, "polys": polys}

# SQL pieces (DuckDB)
P, L, G, T = f"p as ({fx.POINTS})", f"l as ({fx.LINES})", f"g as ({fx.POLYS})", f"t as ({fx.TILES})"
PX = "(lon/360e0+0.5e0)"
PY = "(case when lat>=90 then 0e0 when lat<=-90 then 1e0 else least(greatest(0.5e0-0.25e0*ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/pi(),0e0),1e0) end)"
ZIG = "(case when {0}>=0 then 2*({0}) else -2*({0})-1 end)"
BOXES = """tb as (select z,x,y,x/power(2,z)*360-180 as w0,(x+1)/power(2,z)*360-180 as w2,
  degrees(atan(sinh(pi()-2*pi()*(y+1)/power(2,z)))) as w1, degrees(atan(sinh(pi()-2*pi()*y/power(2,z)))) as w3 from t)"""
FEATURE_BOXES = {
    "points": f"{P}, b as (select fid, lon as minx, lat as miny, lon as maxx, lat as maxy from p)",
    "lines": f"{L}, b as (select fid, min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy from l group by fid)",
    "polys": f"{G}, b as (select fid, min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy from g group by fid)",
}
r9 = lambda c: F.round(c, 9)


@query("project_points", f"with {P} select fid, round({PX},9) as mx, round({PY},9) as my from p")
def project_points(spark, d):
    p = fx.view(spark, d, fx.POINTS)
    return p.select("fid", r9(tm.project_x("lon")).alias("mx"), r9(tm.project_y("lat")).alias("my"))


@query("project_clamp_poles", f"with q as (select p_partkey as k, cast(p_partkey%211-105 as double) as lat from part) select k, round({PY},9) as my from q")
def project_clamp_poles(spark, d):
    q = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 211 - 105).cast("double").alias("lat"))
    return q.select("k", r9(tm.project_y("lat")).alias("my"))


@query("tile_id", f"with {T} select z,x,y, cast(((power(2,z)*y+x)*32+z) as bigint) as id from t")
def tile_id(spark, d):
    return fx.view(spark, d, fx.TILES).select("z", "x", "y", tm.tile_id("z", "x", "y").alias("id"))


@query("tile_bbox", f"with {T}, {BOXES} select z,x,y, round(w0,9) as minx, round(w1,9) as miny, round(w2,9) as maxx, round(w3,9) as maxy from tb")
def tile_bbox(spark, d):
    b = tm.tile_box("z", "x", "y")
    return fx.view(spark, d, fx.TILES).select("z", "x", "y", *[r9(b["w_" + c]).alias(c) for c in ft.BOX])


@query("tile_clip_bounds", f"with {T}, n as (select *, power(2,z) as n, 64e0/4096 as k from t) select z,x,y, round((x-k)/n,9) as minx, round((y-k)/n,9) as miny, round((x+1+k)/n,9) as maxx, round((y+1+k)/n,9) as maxy from n")
def tile_clip_bounds(spark, d):
    b = tm.clip_box("z", "x", "y", F.lit(64), F.lit(4096))
    return fx.view(spark, d, fx.TILES).select("z", "x", "y", *[r9(b["c_" + c]).alias(c) for c in ft.BOX])


@query("sq_tolerance_by_zoom", "select p_partkey as k, p_partkey%25 as z, round(power((p_size%9)/(power(2,p_partkey%25)*4096),2)*1e9,9) as tol from part")
def sq_tolerance_by_zoom(spark, d):
    p = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 25).alias("z"), (F.col("p_size") % 9).cast("double").alias("t"))
    return p.select("k", "z", r9(tm.sq_tolerance("t", "z", F.lit(4096)) * 1e9).alias("tol"))


@query("point_to_tile_z14", f"with {P} select fid, cast(floor({PX}*16384) as bigint) as x, cast(floor({PY}*16384) as bigint) as y from p")
def point_to_tile(spark, d):
    p = fx.view(spark, d, fx.POINTS)
    return p.select("fid", tm.tile_of(tm.project_x("lon"), F.lit(14)).alias("x"), tm.tile_of(tm.project_y("lat"), F.lit(14)).alias("y"))


@query("points_per_tile_z5", f"with {P} select cast(floor({PX}*32) as bigint) as x, cast(floor({PY}*32) as bigint) as y, count(*) as n, round(sum(price),2) as price from p group by 1,2")
def points_per_tile(spark, d):
    p = fx.view(spark, d, fx.POINTS)
    return p.groupBy(tm.tile_of(tm.project_x("lon"), F.lit(5)).alias("x"), tm.tile_of(tm.project_y("lat"), F.lit(5)).alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price"))


Q6 = f"q as (select fid, cast(floor({PX}*64) as bigint) as x, cast(floor({PY}*64) as bigint) as y, {PX} as mx, {PY} as my from p), qq as (select fid,x,y, cast(floor(4096*(mx*64-x)+0.5) as bigint) as qx, cast(floor(4096*(my*64-y)+0.5) as bigint) as qy from q)"


def quantized_points(spark, d) -> DataFrame:
    p = fx.view(spark, d, fx.POINTS).select("fid", tm.project_x("lon").alias("mx"), tm.project_y("lat").alias("my"))
    p = p.withColumn("x", tm.tile_of("mx", F.lit(6))).withColumn("y", tm.tile_of("my", F.lit(6)))
    return p.select("fid", "x", "y", tm.quantize("mx", F.lit(6), "x", F.lit(4096)).alias("qx"), tm.quantize("my", F.lit(6), "y", F.lit(4096)).alias("qy"))


@query("quantize_points", f"with {P}, {Q6} select * from qq")
def quantize_points(spark, d):
    return quantized_points(spark, d)


DELTAS = f"dd as (select x,y,fid, qx-lag(qx,1,0) over (partition by x,y order by fid) as dx, qy-lag(qy,1,0) over (partition by x,y order by fid) as dy from qq), zz as (select x,y,fid,{ZIG.format('dx')} as zx,{ZIG.format('dy')} as zy from dd)"


@query("zigzag_delta_points", f"with {P}, {Q6}, {DELTAS} select * from zz")
def zigzag_delta_points(spark, d):
    w = Window.partitionBy("x", "y").orderBy("fid")
    q = quantized_points(spark, d)
    return q.select("x", "y", "fid", g.zigzag(F.col("qx") - F.lag("qx", 1, 0).over(w)).alias("zx"), g.zigzag(F.col("qy") - F.lag("qy", 1, 0).over(w)).alias("zy"))


@query("encode_point_commands", f"with {P}, {Q6}, {DELTAS} select x,y, cast((count(*)*8+1) as varchar)||','||string_agg(zx||','||zy, ',' order by fid) as commands from zz group by x,y")
def encode_point_commands(spark, d):
    pts = F.transform(F.array_sort(F.collect_list(F.struct("fid", F.col("qx").alias("x"), F.col("qy").alias("y")))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return quantized_points(spark, d).groupBy("x", "y").agg(pts.alias("pts")).select("x", "y", F.array_join(g.encode_points(F.col("pts")).cast("array<string>"), ",").alias("commands"))


def feature_bbox(layer):
    def f(spark, d):
        return LAYERS[layer](spark, d).select("fid", *[r9(F.col(c)).alias(c) for c in ft.BOX])

    return f


def cover(layer, few):
    def f(spark, d):
        joined = grid.cover_join(LAYERS[layer](spark, d), fx.view(spark, d, fx.TILES), 64, 4096, zooms=[0, 1, 2, 3], few=few)
        return joined.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("fid").alias("fids"))

    return f


for _layer in LAYERS:
    _sql = f"with {T}, {BOXES}, {FEATURE_BOXES[_layer]} select z,x,y,count(*) as n,cast(sum(fid) as bigint) as fids from b join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1 group by z,x,y"
    query(f"tile_cover_join_{_layer}_theta", _sql)(cover(_layer, True))
    query(f"tile_cover_join_{_layer}_cells", _sql)(cover(_layer, False))
    if _layer != "points":
        query(f"feature_bbox_{_layer}", f"with {FEATURE_BOXES[_layer]} select fid, round(minx,9) as minx, round(miny,9) as miny, round(maxx,9) as maxx, round(maxy,9) as maxy from b")(feature_bbox(_layer))

#: A box in degrees for clipping queries.
CLIP = (-100.25, -40.5, 95.75, 50.125)
IN = "minx<=95.75 and maxx>=-100.25 and miny<=50.125 and maxy>=-40.5"
WITHIN = "minx>=-100.25 and maxx<=95.75 and miny>=-40.5 and maxy<=50.125"


@query("trivial_accept_reject_counts", f"with {FEATURE_BOXES['polys']} select case when not({IN}) then 'reject' when {WITHIN} then 'accept' else 'clip' end as kind, count(*) as n from b group by 1")
def trivial(spark, d):
    x0, y0, x1, y1 = CLIP
    out = ~tm.boxes_meet(ft.BOX, CLIP)
    within = (F.col("minx") >= x0) & (F.col("maxx") <= x1) & (F.col("miny") >= y0) & (F.col("maxy") <= y1)
    return polys(spark, d).groupBy(F.when(out, "reject").when(within, "accept").otherwise("clip").alias("kind")).agg(F.count("*").alias("n"))


@query("clip_points_box", f"with {P} select fid, round(lon,9) as x, round(lat,9) as y from p where lon between -100.25 and 95.75 and lat between -40.5 and 50.125")
def clip_points_box(spark, d):
    box = dict(zip(("c_minx", "c_miny", "c_maxx", "c_maxy"), map(F.lit, CLIP), strict=True))
    kept = points(spark, d).select("fid", F.explode(g.clip_points(g.all_points(F.col("rings")), box)).alias("p"))
    return kept.select("fid", r9(F.col("p.x")).alias("x"), r9(F.col("p.y")).alias("y"))


def slab(src: str, out: str, lo: float, hi: float, axis: str, poly: bool) -> str:
    """CTEs that cut src (fid, ring, vtx, x, y) to a slab and name the result out."""
    o = "y" if axis == "x" else "x"
    lo, hi = f"({lo}e0)", f"({hi}e0)"
    va, vb = axis, f"e{axis}"
    enter, leave = f"(case when {va}<{lo} then {lo} else {hi} end)", f"(case when {vb}<{lo} then {lo} else {hi} end)"
    meet = lambda k: f"{o}+(e{o}-{o})*(({k}-{va})/({vb}-{va}))"
    pt = lambda k: f"{k} as x, {meet(k)} as y" if axis == "x" else f"{meet(k)} as x, {k} as y"
    a_in, b_in = f"({va}>={lo} and {va}<={hi})", f"({vb}>={lo} and {vb}<={hi})"
    cross = f"(({va}<{lo} and {vb}>{hi}) or ({va}>{hi} and {vb}<{lo}))"
    sql = f"""{out}_e as (select fid,ring,vtx,x::double as x,y::double as y, lead(x::double) over w as ex, lead(y::double) over w as ey, count(*) over (partition by fid,ring) as n from {src} window w as (partition by fid,ring order by vtx)),
{out}_s as (select fid,ring,vtx,0 as slot,x,y,false as cut from {out}_e where n>=2 and {a_in}
 union all select fid,ring,vtx,0,{pt(enter)},false from {out}_e where n>=2 and ex is not null and not {a_in} and ({b_in} or {cross})
 union all select fid,ring,vtx,1,{pt(leave)},true from {out}_e where n>=2 and ex is not null and not {b_in} and ({a_in} or {cross})),
"""
    if poly:
        return sql + f"""{out}_r as (select fid,ring,x,y,row_number() over (partition by fid,ring order by vtx,slot) as k, count(*) over (partition by fid,ring) as c from {out}_s),
{out}_c as (select fid,ring,x,y,k,c from {out}_r union all select f.fid,f.ring,f.x,f.y,f.c+1,f.c from {out}_r f join {out}_r e on f.fid=e.fid and f.ring=e.ring and f.k=1 and e.k=e.c where f.c>=3 and (f.x<>e.x or f.y<>e.y)),
{out} as (select fid,ring,cast(k-1 as int) as vtx,x,y from {out}_c where c>=2)"""
    return sql + f"""{out}_r as (select *, coalesce(sum(cut::int) over (partition by fid,ring order by vtx,slot rows between unbounded preceding and 1 preceding),0) as slice from {out}_s),
{out}_c as (select *, count(*) over (partition by fid,ring,slice) as c, row_number() over (partition by fid,ring,slice order by vtx,slot) as k from {out}_r),
{out} as (select fid, dense_rank() over (partition by fid order by ring,slice)-1 as ring, cast(k-1 as int) as vtx, x, y from {out}_c where c>=2)"""


VERTEX = "select fid, cast(ring as int) as ring, vtx, round(x,9) as x, round(y,9) as y from"


def exploded(df: DataFrame, rings: str = "rings") -> DataFrame:
    r = df.select("fid", F.posexplode(rings).alias("ring", "r")).select("fid", "ring", F.posexplode("r.pts").alias("vtx", "p"))
    return r.select("fid", "ring", "vtx", r9(F.col("p.x")).alias("x"), r9(F.col("p.y")).alias("y"))


#: Rings renumbered without gaps, as arrays have them.
GR = "gr as (select fid, dense_rank() over (partition by fid order by ring)-1 as ring, vtx, lon as x, lat as y, ext from g)"


def by_kernel(df: DataFrame, work, keys: tuple[str, ...] = ("fid",)) -> DataFrame:
    """The keys and rings through an array kernel (Rings, number of features) -> Rings."""

    def run(batches):
        for b in batches:
            r = flat_rings(b.column("rings"))
            out = work(r, b.num_rows)
            xy = pa.StructArray.from_arrays([pa.array(out.x.astype(float)), pa.array(out.y.astype(float))], ["x", "y"])
            pts = pa.ListArray.from_arrays(pa.array(out.ring.astype(np.int32)), xy)
            at = np.searchsorted(out.feat, np.arange(b.num_rows + 1)).astype(np.int32)
            rings = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(out.ext.astype(bool)), pts], ["ext", "pts"]))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), rings], names=[*keys, "rings"])

    kinds = dict(df.dtypes)
    return df.select(*keys, "rings").mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"rings {g.RINGS}"]))


def a_ring_a_row(df: DataFrame) -> DataFrame:
    """fid, ring (its number) and rings, which holds this ring alone."""
    return df.select("fid", F.posexplode("rings").alias("ring", "r")).select("fid", "ring", F.array("r").alias("rings"))


def ring_values(df: DataFrame, work) -> DataFrame:
    """fid, ring, v: a number for each ring from a kernel."""

    def put(r, n):
        return kernels.Rings(work(r).astype(float), np.zeros(n), np.arange(n + 1), np.arange(n), np.ones(n, bool))

    return by_kernel(a_ring_a_row(df), put, ("fid", "ring")).select("fid", "ring", F.col("rings")[0]["pts"][0]["x"].alias("v"))


def clipped_polys(spark, d, axes: str) -> DataFrame:
    """Polygons' vertices after clipping; ring numbers are those before."""

    def cut(r, n):
        for k, axis in enumerate("xy"):
            if axis in axes:
                r = kernels.clip_axis(r, np.full(len(r.feat), CLIP[k]), np.full(len(r.feat), CLIP[k + 2]), np.ones(len(r.feat), bool), k)
        return r

    v = by_kernel(a_ring_a_row(polys(spark, d)), cut, ("fid", "ring")).select("fid", "ring", F.explode("rings").alias("r"))
    v = v.select("fid", "ring", F.posexplode("r.pts").alias("vtx", "p"))
    return v.select("fid", "ring", "vtx", r9(F.col("p.x")).alias("x"), r9(F.col("p.y")).alias("y"))


@query("clip_polygon_slab_x", f"with {G}, {GR}, {slab('gr', 'c1', CLIP[0], CLIP[2], 'x', True)} {VERTEX} c1")
def clip_polygon_slab_x(spark, d):
    return clipped_polys(spark, d, "x")


@query("clip_polygon_box", f"with {G}, {GR}, {slab('gr', 'c1', CLIP[0], CLIP[2], 'x', True)}, {slab('c1', 'c2', CLIP[1], CLIP[3], 'y', True)} {VERTEX} c2")
def clip_polygon_box(spark, d):
    return clipped_polys(spark, d, "xy")


#: The same lines, each beside its own origin, so that one box cuts all of them.
LOCAL = "select user_id as fid, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as vtx, (row_number() over (partition by user_id order by ts, event_id)-1)*1e-2 as lon, value/1e3 as lat from events"


@query("clip_lines_box", f"with l as ({LOCAL}), lr as (select fid, 0 as ring, vtx, lon as x, lat as y from l), {slab('lr', 'c1', 0.055, 0.505, 'x', False)}, {slab('c1', 'c2', 0.0105, 0.0655, 'y', False)} {VERTEX} c2")
def clip_lines_box(spark, d):
    def cut(r, n):
        box = tuple(np.full(n, v) for v in (0.055, 0.0105, 0.505, 0.0655))
        return kernels.clip(r, box, np.zeros(n, bool))

    return exploded(by_kernel(ft.from_vertices(fx.view(spark, d, LOCAL), g.LINE), cut))


#: The squared tolerance of 3 units of 4096, in tiles.
TILE_TOL = "power(3e0/4096,2)"


def splits(tol: str) -> str:
    """CTEs from v (fid, vtx, x, y) to kept_vtx (fid, vtx): what simplification keeps."""
    dist = "(case when l2=0 then power(x-ax,2)+power(y-ay,2) when ((x-ax)*dx+(y-ay)*dy)/l2>1 then (x-ex)*(x-ex)+(y-ey)*(y-ey) when ((x-ax)*dx+(y-ay)*dy)/l2>0 then (x-(ax+dx*(((x-ax)*dx+(y-ay)*dy)/l2)))*(x-(ax+dx*(((x-ax)*dx+(y-ay)*dy)/l2)))+(y-(ay+dy*(((x-ax)*dx+(y-ay)*dy)/l2)))*(y-(ay+dy*(((x-ax)*dx+(y-ay)*dy)/l2))) else (x-ax)*(x-ax)+(y-ay)*(y-ay) end)"
    return f"""e as (select fid, max(vtx) as last from v group by fid),
s(fid, first, last, split, imp) as (
  select fid, 0, last, -1, 0e0 from e where last>1
  union all
  select c.fid, c.f, c.t, c.vtx, c.d from (
    select fid, vtx, d, unnest([first, vtx]) as f, unnest([vtx, last]) as t from (
      select *, row_number() over (partition by fid, first, last order by d desc, abs(vtx-((first+last)>>1)), vtx) as k from (
        select fid, first, last, vtx, {dist} as d from (
          select s.fid, s.first, s.last, v.vtx, v.x, v.y, a.x as ax, a.y as ay, b.x as ex, b.y as ey, b.x-a.x as dx, b.y-a.y as dy, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) as l2
          from s join v on v.fid=s.fid and v.vtx>s.first and v.vtx<s.last join v a on a.fid=s.fid and a.vtx=s.first join v b on b.fid=s.fid and b.vtx=s.last)) where d>0) where k=1) c),
kept_vtx as (select distinct fid, cast(split as int) as vtx from s where split>=0 and imp>{tol} union select fid, 0 from e union select fid, cast(last as int) from e)"""


def simplify_sql(z: int) -> str:
    return f"with recursive {L}, v as (select fid, vtx, lon::double as x, lat::double as y from l), {splits(f'power(3e0*360/(power(2,{z})*4096),2)')} select fid, vtx from kept_vtx"


def simplify_lines(z: int):
    def f(spark, d):
        tol = (3 * 360 / (2**z * 4096)) ** 2

        def work(r, n):
            imp = kernels.importance(r, "nearest")  # as the SQL orders them
            k = (np.arange(len(r.x)) - r.ring[:-1][r.of_vertex()]).astype(float)
            keep = imp > tol
            return kernels.Rings(k[keep], imp[keep], np.r_[0, np.cumsum(kernels.sums(keep.astype(np.int64), r.ring))], r.feat, r.ext)

        v = by_kernel(lines(spark, d), work).select("fid", F.explode("rings").alias("r")).select("fid", F.explode("r.pts").alias("p"))
        return v.select("fid", F.col("p.x").cast("int").alias("vtx"))

    return f


for _z in (2, 6, 8):
    query(f"simplify_lines_z{_z}", simplify_sql(_z))(simplify_lines(_z))


@query("ring_too_small", f"with {G}, {GR} select fid, cast(ring as int) as ring, (max(x)-min(x))*(max(y)-min(y))<0.04e0 as small from gr group by fid, ring")
def ring_too_small(spark, d):
    return ring_values(polys(spark, d), lambda r: kernels.box_areas(r) < 0.04).select("fid", "ring", (F.col("v") == 1).alias("small"))


#: Vertices in whole thousandths of a degree, y down, and the signed area of rings.
WHOLE = "gi as (select fid, ring, vtx, ext, cast(floor(x*1000+0.5e0) as bigint) as x, cast(floor(-y*1000+0.5e0) as bigint) as y from gr)"
AREA = "ga as (select *, count(*) over (partition by fid,ring) as n, coalesce(lag(x) over w, last_value(x) over (partition by fid,ring order by vtx rows between unbounded preceding and unbounded following)) as px, coalesce(lag(y) over w, last_value(y) over (partition by fid,ring order by vtx rows between unbounded preceding and unbounded following)) as py from gi window w as (partition by fid,ring order by vtx)), gs as (select fid, ring, cast(sum((x-px)*(y+py)) as double) as area, bool_or(ext) as ext from ga group by fid, ring)"


def whole_polys(spark, d) -> DataFrame:
    pt = lambda p: F.struct(F.floor(p["x"] * 1000 + 0.5).cast("double").alias("x"), F.floor(-p["y"] * 1000 + 0.5).cast("double").alias("y"))
    return polys(spark, d).select("fid", F.transform("rings", lambda r: F.struct(r["ext"].alias("ext"), F.transform(r["pts"], pt).alias("pts"))).alias("rings"))


@query("signed_area_rings", f"with {G}, {GR}, {WHOLE}, {AREA} select fid, cast(ring as int) as ring, area from gs")
def signed_area_rings(spark, d):
    return ring_values(whole_polys(spark, d), kernels.signed_areas).withColumnRenamed("v", "area")


WOUND = "gw as (select i.fid, i.ring, case when (s.area>0)<>s.ext then count(*) over (partition by i.fid,i.ring)-1-i.vtx else i.vtx end as vtx, i.x, i.y from gi i join gs s on i.fid=s.fid and i.ring=s.ring)"


@query("correct_winding", f"with {G}, {GR}, {WHOLE}, {AREA}, {WOUND} select fid, cast(ring as int) as ring, cast(vtx as int) as vtx, x, y from gw")
def correct_winding(spark, d):
    turned = by_kernel(whole_polys(spark, d), lambda r, n: kernels.wind(r, np.ones(n, bool)))
    v = turned.select("fid", F.posexplode("rings").alias("ring", "r")).select("fid", "ring", F.posexplode("r.pts").alias("vtx", "p"))
    return v.select("fid", "ring", "vtx", F.col("p.x").cast("long").alias("x"), F.col("p.y").cast("long").alias("y"))


def commands(df: DataFrame, poly: bool) -> DataFrame:
    """fid and the commands of whole-numbered rings, as a text; features without commands vanish."""

    def run(batches):
        for b in batches:
            r = flat_rings(b.column("rings"))
            whole = kernels.Rings(r.x.astype(np.int64), r.y.astype(np.int64), r.ring, r.feat, r.ext)
            values, at = kernels.encode(whole, np.full(b.num_rows, poly), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("fid"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))], names=["fid", "c"])

    found = df.select("fid", F.col("rings").cast(g.RINGS).alias("rings")).mapInArrow(run, "fid bigint, c array<bigint>")
    return found.where(F.size("c") > 0).select("fid", F.array_join(F.col("c").cast("array<string>"), ",").alias("commands"))


def zig(e: str) -> str:
    return ZIG.format(e)


@query("encode_line_commands", f"""with {L}, li as (select fid, vtx, cast(floor(lon*1000+0.5e0) as bigint) as x, cast(floor(lat*1000+0.5e0) as bigint) as y from l),
ld as (select fid, vtx, x-lag(x,1,0) over w as dx, y-lag(y,1,0) over w as dy, count(*) over (partition by fid) as n from li window w as (partition by fid order by vtx))
select fid, string_agg(case vtx when 0 then '9,' when 1 then cast((n-1)*8+2 as varchar)||',' else '' end||{zig('dx')}||','||{zig('dy')}, ',' order by vtx) as commands from ld where n>=2 group by fid""")
def encode_line_commands(spark, d):
    pt = lambda p: F.struct(F.floor(p["x"] * 1000 + 0.5).alias("x"), F.floor(p["y"] * 1000 + 0.5).alias("y"))
    return commands(lines(spark, d).select("fid", F.transform("rings", lambda r: F.struct(r["ext"].alias("ext"), F.transform(r["pts"], pt).alias("pts"))).alias("rings")), False)


@query("encode_polygon_commands", f"""with {G}, {GR}, {WHOLE}, gn as (select *, count(*) over (partition by fid,ring) as n from gi),
gd as (select fid, ring, vtx, n, x-lag(x,1,0) over w as dx, y-lag(y,1,0) over w as dy from gn where vtx<n-1 window w as (partition by fid order by ring,vtx))
select fid, string_agg(case vtx when 0 then '9,' when 1 then cast((n-2)*8+2 as varchar)||',' else '' end||{zig('dx')}||','||{zig('dy')}||case when vtx=n-2 then ',15' else '' end, ',' order by ring,vtx) as commands from gd group by fid""")
def encode_polygon_commands(spark, d):
    return commands(whole_polys(spark, d), True)


# dictionaries: orders as points in every tile of the grid, properties in the order status, priority, flag, cost, level
PROPS = f"""{T}, {BOXES}, {FEATURE_BOXES['points']},
o as (select o_orderkey as fid, nullif(o_orderstatus,'P') as status, o_orderpriority as priority, o_totalprice>2e5 as flag, cast(floor(o_totalprice/5e3) as double) as cost, -cast(o_custkey%50 as bigint) as level from orders),
kv as (select fid, 0 as po, 'status' as k, case when status is not null then 'string' end as t, status as v from o
 union all select fid, 1, 'priority', 'string', priority from o
 union all select fid, 2, 'flag', 'bool', cast(flag as varchar) from o
 union all select fid, 3, 'cost', 'uint', cast(cast(cost as bigint) as varchar) from o
 union all select fid, 4, 'level', case when level>=0 then 'uint' else 'int' end, cast(level as varchar) from o),
kv1 as (select * from kv where t is not null),
at as (select z,x,y,b.fid from b join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1),
kt as (select z,x,y,kv1.* from kv1 join "at" on "at".fid=kv1.fid),
ks as (select z, x, y, k, row_number() over (partition by z, x, y order by min(fid*8+po))-1 as i from kt group by z, x, y, k),
vs as (select z, x, y, t, v, row_number() over (partition by z, x, y order by min(fid*8+po))-1 as i from kt group by z, x, y, t, v)""".replace("at as (select z", '"at" as (select z')


def property_rows(spark, d) -> DataFrame:
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("fid"), F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.col("o_orderpriority").alias("priority"),
        (F.col("o_totalprice") > 2e5).alias("flag"), F.floor(F.col("o_totalprice") / 5e3).cast("double").alias("cost"), (-(F.col("o_custkey") % 50)).alias("level"),
    )


def property_layer(spark, d) -> DataFrame:
    o = property_rows(spark, d)
    return o.select("fid", g.tags_of([(n, t) for n, t in o.dtypes if n != "fid"]).alias("props"))


def property_tiles(spark, d) -> DataFrame:
    """The pieces of all tiles of the grid. Tiles of more than 2000 orders are put together in two levels, those of zooms 0
    and 1 on every table, others by the stream of a task."""
    at = fx.view(spark, d, fx.POINTS).select("fid", "lon", "lat").join(property_rows(spark, d), "fid")
    e = TileEngine(spark, Source("orders", ft.from_points(at, "fid", "lon", "lat"), id_col="fid"), Options(tolerance=0), hot=2000)
    return e.pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])


#: Sections of pieces.
HEADS, KEYS, VALUES, FEATURES = -1, 0, 1, 2


def read_pieces(pieces: DataFrame, section: int, schema: str, columns) -> DataFrame:
    """z, x, y and what the pieces of a section hold, a piece at a time. columns gives its columns from a piece's bytes,
    the number of its first item, and its layer (ord)."""
    schema = f"z int, x long, y long, {schema}"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            raws = b.column("bytes")
            for i, (z, x, y, o, first) in enumerate(zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "ord", "first")), strict=True)):
                found = columns(raws[i].as_buffer(), first, o)
                own = [np.full(len(found[0]), v) for v in (z, x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*own, *found), target, strict=True)], schema=target)

    return pieces.where((F.col("ord") >= 0) & (F.col("section") == section)).select("z", "x", "y", "ord", "first", "bytes").mapInArrow(run, schema)


def joined_tags(raw, first, o):
    f = pbf.features(raw)
    texts, at = list(map(str, f.tags.tolist())), f.tag_at.tolist()
    return f.id, [",".join(texts[a:b]) for a, b in zip(at, at[1:])]


def numbered_keys(raw, first, o):
    found = pbf.items(raw.to_pybytes())
    return np.arange(first, first + len(found)), found


def numbered_values(raw, first, o):
    found = pbf.items(raw.to_pybytes())
    text = lambda t, v: ("false", "true")[v] if t == "bool" else str(v) if t in ("uint", "int", "string") else None
    return np.arange(first, first + len(found)), [t for t, _ in found], [text(*v) for v in found]


def value_text(v: str = "v"):
    return F.coalesce(f"{v}.s", F.col(f"{v}.i").cast("string"), F.col(f"{v}.b").cast("string"))


@query("layer_keys", f"with {PROPS} select cast(z as int) as z, x, y, cast(i as int) as i, k from ks")
def layer_keys(spark, d):
    return read_pieces(property_tiles(spark, d), KEYS, "i int, k string", numbered_keys)


@query("layer_values", f"with {PROPS} select cast(z as int) as z, x, y, cast(i as int) as i, t, v from vs")
def layer_values(spark, d):
    return read_pieces(property_tiles(spark, d), VALUES, "i int, t string, v string", numbered_values)


@query("feature_tags", f"with {PROPS} select cast(a.z as int) as z, a.x, a.y, a.fid, string_agg(ks.i||','||vs.i, ',' order by a.po) as tags from kt a join ks on a.z=ks.z and a.x=ks.x and a.y=ks.y and a.k=ks.k join vs on a.z=vs.z and a.x=vs.x and a.y=vs.y and a.t=vs.t and a.v=vs.v group by a.z, a.x, a.y, a.fid")
def feature_tags(spark, d):
    return read_pieces(property_tiles(spark, d), FEATURES, "fid long, tags string", joined_tags)


@query("value_type_histogram", f"with {PROPS} select k, t, count(*) as n, count(distinct v) as distinct_values from kv1 group by k, t")
def value_type_histogram(spark, d):
    p = property_layer(spark, d).select(F.explode("props").alias("p")).select("p.k", "p.v")
    return p.groupBy("k", F.col("v.t").alias("t")).agg(F.count("*").alias("n"), F.countDistinct(value_text()).alias("distinct_values"))


def engine(spark, d, names=("points", "polys"), behaviour=Behaviour(), **options) -> TileEngine:
    return TileEngine(spark, [Source(n, LAYERS[n](spark, d), Options(**options.get(n, {})), id_col="fid") for n in names], Options(**{k: v for k, v in options.items() if k not in LAYERS}), behaviour)


COUNTS = f"""{T}, {BOXES}, {FEATURE_BOXES['points']}, {FEATURE_BOXES['polys'].replace('b as', 'b2 as')},
src as (select 0 as ord, 'points' as layer, fid, minx, miny, maxx, maxy from b union all select 1, 'polys', fid, minx, miny, maxx, maxy from b2),
names as (select 0 as ord, 'points' as layer union all select 1, 'polys')"""


def counted(layers: DataFrame, names: list[str]) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, names)), F.col("ord") + 1)
    return layers.select("z", "x", "y", name.alias("layer"), F.col("n").cast("long").alias("n"))


@query("tile_layer_counts", f"with {COUNTS} select z,x,y,names.layer, count(fid) as n from tb cross join names left join src on src.ord=names.ord and minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1 group by z,x,y,names.layer")
def tile_layer_counts(spark, d):
    e = engine(spark, d, tolerance=0)
    return counted(e.counts(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3]), ["points", "polys"])


MULTI = f"with {COUNTS} select z,x,y,names.layer, count(fid) as n from tb cross join names left join src on src.ord=names.ord and minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1 and names.layer='points' group by z,x,y,names.layer"


@query("multi_source_layers", MULTI)
def multi_source_layers(spark, d):
    """Polygons only from zoom 4 on: their layer is there, and empty."""
    e = engine(spark, d, polys={"min_zoom": 4}, tolerance=0)
    return counted(e.counts(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3]), ["points", "polys"])


#: A source for each part, with options that are set, null or 0.
SOURCES = """select p_partkey as ordinal, case when p_size%3>0 then 512*(p_size%4+1) end as extent, case when p_size%5>0 then p_size%5*16-16 end as buffer,
 case when p_size%4>0 then cast(p_size%4-1 as double) end as tolerance, case when p_partkey%3>0 then p_size%6 end as max_zoom, case when p_size%2>0 then p_size%7 end as min_zoom from part"""


def source_table(spark, d) -> DataFrame:
    return resolved(fx.view(spark, d, SOURCES), Options(tolerance=7, max_zoom=4))


@query("option_cascade", f"with src as ({SOURCES}) select ordinal, cast(coalesce(extent,4096) as int) as extent, cast(coalesce(buffer,64) as int) as buffer, cast(coalesce(tolerance,7) as double) as tolerance, cast(coalesce(max_zoom,4) as int) as max_zoom, cast(coalesce(min_zoom,0) as int) as min_zoom from src")
def option_cascade(spark, d):
    return source_table(spark, d)


@query("zoom_gated_sources", f"with src as ({SOURCES}), {T} select ordinal, z, count(*) as n from src join t on z between coalesce(min_zoom,0) and coalesce(max_zoom,4) group by ordinal, z")
def zoom_gated_sources(spark, d):
    tiles_of_zoom = fx.view(spark, d, fx.TILES).groupBy("z").agg(F.count("*").alias("n"))  # a row a zoom
    return source_table(spark, d).join(F.broadcast(tiles_of_zoom), F.col("z").between(F.col("min_zoom"), F.col("max_zoom"))).select("ordinal", "z", "n")


#: Points in the order of their keys as a file has them: a feature has 60 bytes, and some more for its priority.
PLACED = f"""select p.*, byte_end - size as byte_at, byte_end from (select p.*, 60+fid%7*9 as size, cast(sum(60+fid%7*9) over (order by fid) as bigint) as byte_end from ({fx.POINTS}) p) p"""


@query("fgb_layout_candidates", f"""with {T}, {BOXES}, p as materialized ({PLACED}), m as (select p.*, {PX} as mx, {PY} as my from p),
h as (select z,x,y,byte_at,byte_end from p join tb on lon<=w2 and lon>=w0 and lat<=w3 and lat>=w1),
e as (select *, max(byte_end) over (partition by z,x,y order by byte_at rows between unbounded preceding and 1 preceding) as far from h),
i as (select *, sum(case when far is null or byte_at>far+512 then 1 else 0 end) over (partition by z,x,y order by byte_at) as isle from e),
s as (select z,x,y,isle,min(byte_at) as lo,max(byte_end) as hi from i group by z,x,y,isle)
select cast(s.z as int) as z,s.x,s.y,m.fid, cast(floor(4096*(mx*power(2,s.z)-s.x)+0.5) as bigint) as px, cast(floor(4096*(my*power(2,s.z)-s.y)+0.5) as bigint) as py
from s join m on m.byte_at>=s.lo and m.byte_end<=s.hi where mx*power(2,s.z) between s.x-0.015625 and s.x+1.015625 and my*power(2,s.z) between s.y-0.015625 and s.y+1.015625""")
def fgb_layout_candidates(spark, d):
    """Points of all tiles of the grid, those of buffers among them where bytes between the tile's own carry them along."""
    # running sums by blocks of keys, so that no task meets all of them
    p = fx.view(spark, d, fx.POINTS).withColumn("size", F.lit(60) + F.col("fid") % 7 * 9).withColumn("_b", F.floor(F.col("fid") / 4096))
    w = Window.partitionBy("_b").orderBy("fid")
    base = p.groupBy("_b").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    p = p.join(base.select("_b", "base"), "_b").withColumn("byte_end", F.col("base") + F.sum("size").over(w)).withColumn("byte_at", F.col("byte_end") - F.col("size"))
    made = TileEngine(spark, Source("points", ft.from_points(p.drop("size", "_b", "base"), "fid", "lon", "lat"), id_col="fid"), Options(tolerance=0), Behaviour(candidates="fgb_layout"))
    got = made.pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])
    return read_pieces(got, FEATURES, "fid long, px long, py long", lambda raw, first, o: ((f := pbf.features(raw)).id, *f.points()))


@query("tilejson_bounds", f"""with {FEATURE_BOXES['points']}, {FEATURE_BOXES['polys'].replace('b as', 'b2 as')}, a as (select * from b union all select * from b2)
select round(min(minx),9) as minx, round(min(miny),9) as miny, round(max(maxx),9) as maxx, round(max(maxy),9) as maxy, 0 as minzoom, 24 as maxzoom from a""")
def tilejson_bounds(spark, d):
    j = engine(spark, d).tilejson_frame()
    return j.select(*[r9(F.col("bounds")[i]).alias(c) for i, c in enumerate(ft.BOX)], "minzoom", "maxzoom")


@query("tilejson_fields", f"""with {P} select 'points' as layer, f as field, kind, n from (
select 'status' as f, 'String' as kind, count(status) as n from p union all select 'priority', 'String', count(priority) from p union all select 'price', 'Number', count(price) from p union all select 'cust', 'Number', count(cust) from p)""")
def tilejson_fields(spark, d):
    """Fields of all layers as metadata names them, and in how many features each is set."""
    out = None
    for n in ("points", "polys"):
        df = LAYERS[n](spark, d)
        fields = ft.property_columns(df, None)
        if fields:
            counts = df.agg(*[F.count(c).alias(c) for c, _ in fields])
            rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lit(type_label(t)).alias("kind"), F.col(c).alias("n")) for c, t in fields])).alias("f")).select(F.lit(n).alias("layer"), "f.*")
            out = rows if out is None else out.unionByName(rows)
    return out


def decoded(tiles_df: DataFrame, schema: str, rows_of) -> DataFrame:
    """Rows made from decoded tiles."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for b in batches:
            out = [r for z, x, y, raw in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "pbf")), strict=True) for r in rows_of(z, x, y, pbf.decode(raw))]
            cols = list(zip(*out, strict=True)) if out else [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target, strict=True)], schema=target)

    return tiles_df.mapInArrow(run, schema)


ROUNDTRIP = f"""with {T}, {BOXES}, {FEATURE_BOXES['points']}, m as (select p.*, {PX} as mx, {PY} as my from p)
select z,x,y,m.fid, cast(floor(4096*(mx*power(2,z)-x)+0.5) as bigint) as px, cast(floor(4096*(my*power(2,z)-y)+0.5) as bigint) as py, status, priority, cast(round(price*100) as bigint) as cents, cast(cust as bigint) as cust
from m join b on m.fid=b.fid join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1"""


@query("mvt_roundtrip_points", ROUNDTRIP)
def mvt_roundtrip_points(spark, d):
    pieces = engine(spark, d, ("points",)).pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])
    schema = "z int, x long, y long, fid long, px long, py long, status string, priority string, cents long, cust long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        tile = keys = values = None
        for b in batches:
            raws = b.column("bytes")
            for i, (*at, section) in enumerate(zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "section")), strict=True)):
                if at != tile:
                    tile, keys, values = at, [], Dictionary()
                if section == KEYS:
                    keys += pbf.items(raws[i].as_py())
                elif section == VALUES:
                    values.add(pbf.items(raws[i].as_py()))
                else:
                    f = pbf.features(raws[i].as_buffer())
                    row = np.repeat(np.arange(len(f.id)), np.diff(f.tag_at) // 2)
                    of = {k: (row[m], f.tags[1::2][m]) for k, name in enumerate(keys) for m in [f.tags[::2] == k]}
                    text, number, whole = ({name: get(*of[k], len(f.id)) for k, name in enumerate(keys)} for get in (values.texts, values.doubles, values.longs))
                    cols = [*(np.full(len(f.id), v) for v in tile), f.id, *f.points(), text["status"], text["priority"], np.floor(number["price"] * 100 + 0.5), whole["cust"]]
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(t.type) for c, t in zip(cols, target, strict=True)], schema=target)

    # a tile's dictionary comes before its features, which stream by
    dealt = pieces.where("ord >= 0").repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "ord", "section", "run", "part")
    return dealt.select("z", "x", "y", "section", "bytes").mapInArrow(run, schema)


class Dictionary:
    """The values of a layer by number, in some twenty bytes each."""

    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, found: list[tuple]) -> None:
        number = lambda t: t in ("uint", "int", "double")
        text = pa.array([v if t == "string" else None for t, v in found], pa.string())
        whole = np.array([v if t in ("uint", "int") else 0 for t, v in found], np.int64)
        self.parts.append((text, whole, np.array([float(v) if number(t) else np.nan for t, v in found])))

    def all(self) -> tuple:
        if len(self.parts) != 1:
            self.parts = [(pa.chunked_array([p[0] for p in self.parts], pa.string()).combine_chunks(), *(np.concatenate([p[k] for p in self.parts] or [np.zeros(0)]) for k in (1, 2)))]
        return self.parts[0]

    def texts(self, row, number, n):
        at = np.full(n, -1)
        at[row] = number
        return self.all()[0].take(pa.array(at, mask=at < 0))

    def longs(self, row, number, n):
        out = np.zeros(n, np.int64)
        out[row] = self.all()[1][number]
        return out

    def doubles(self, row, number, n):
        out = np.full(n, np.nan)
        out[row] = self.all()[2][number]
        return out


#: Polygons in units of their tile, cut to its box with the buffer, quantised, with the role and direction of each
#: ring that is left; pid stands for a feature in a tile.
def cut_sql(vertices: str, n: int = 8) -> str:
    """From the CTEs vertices (fid, ring, vtx, ext, lon, lat), b (their boxes) and tb (tiles of up to n columns); fid of
    a feature in a tile tells all of them."""
    roles = f"fid//{8 * n * n}"
    return f"""k as (select b.fid, z, x as tx, y as ty from b join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1),
src as (select ((g.fid*8+z)*{n}+tx)*{n}+ty as fid, g.ring, g.vtx, {PX}*power(2,z)-tx as x, {PY}*power(2,z)-ty as y from {vertices} g join k on g.fid=k.fid),
{slab('src', 'c1', -0.015625, 1.015625, 'x', True)}, {slab('c1', 'c2', -0.015625, 1.015625, 'y', True)},
q as (select fid, ring, vtx, cast(floor(4096*x+0.5) as bigint) as x, cast(floor(4096*y+0.5) as bigint) as y, count(*) over (partition by fid,ring) as n from c2),
parts as (select fid, ring, any_value(ext) as ext from {vertices} group by fid, ring), roles as (select fid, count(*) filter (ext)>1 as several from parts group by fid),
kept as (select distinct q.fid, q.ring, parts.ext from q join parts on parts.fid=q.{roles} and parts.ring=q.ring),
role as (select k1.fid, k1.ring, case when r.several and count(*) filter (k1.ext) over (partition by k1.fid)>1 then k1.ext else k1.ring=min(k1.ring) over (partition by k1.fid) end as ext from kept k1 join roles r on r.fid=k1.{roles}),
ends as (select fid, ring, max(n) as n, arg_max(x,vtx) as lx, arg_max(y,vtx) as ly, arg_min(x,vtx) as fx, arg_min(y,vtx) as fy from q group by fid, ring),
areas as (select q.fid, q.ring, sum((q.x-coalesce(p.x,e.lx))*(q.y+coalesce(p.y,e.ly))) as area from q join ends e on e.fid=q.fid and e.ring=q.ring left join q p on p.fid=q.fid and p.ring=q.ring and p.vtx=q.vtx-1 group by q.fid, q.ring),
turned as (select q.fid, q.ring, case when (a.area>0)<>r.ext then q.n-1-q.vtx else q.vtx end as vtx, q.x, q.y, q.n-case when q.n>=3 and e.fx=e.lx and e.fy=e.ly then 1 else 0 end as w
  from q join areas a on a.fid=q.fid and a.ring=q.ring join role r on r.fid=q.fid and r.ring=q.ring join ends e on e.fid=q.fid and e.ring=q.ring),
out as (select *, dense_rank() over (partition by fid order by ring)-1 as k from turned where w>=3 and vtx<w)"""


def of_tile(n: int = 8, kind: int = 3) -> str:
    return f"select cast((fid//{n * n})%8 as int) as z, (fid//{n})%{n} as x, fid%{n} as y, fid//{8 * n * n} as fid, {kind} as kind, cast(k as int) as ring, cast(vtx as int) as vtx, x as px, y as py from out"


PATHS = "fid long, kind int, ring int, vtx int, px long, py long"


def paths(raw, first, o):
    """Every vertex of every feature of a piece, in order; of polygons without the last one, which repeats the first."""
    f = pbf.features(raw)
    of, size, x, y = f.paths()
    ring = np.arange(len(of)) - np.searchsorted(of, of)
    own = np.repeat(of, size)
    return f.id[own], f.kind[own], np.repeat(ring, size), np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size), x, y


@query("mvt_polygon_paths", f"with {T}, {BOXES}, {FEATURE_BOXES['polys']}, {cut_sql('g')} {of_tile()}")
def mvt_polygon_paths(spark, d):
    """Every vertex of every polygon in every tile of the grid, as decoded: clipped, wound and encoded, in order."""
    made = engine(spark, d, ("polys",), tolerance=0).pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])
    return read_pieces(made, FEATURES, PATHS, paths)


TRIANGLE_BOXES = f"r as materialized ({fx.TRIANGLES}), b as (select fid, min(lon) as minx, min(lat) as miny, max(lon) as maxx, max(lat) as maxy from r group by fid)"
DEEPER = fx.TILES.replace("select 3)", "select 3 union all select 4)")


@query("pyramid_descent_polys", f"with t as ({DEEPER}), {BOXES}, {TRIANGLE_BOXES}, {cut_sql('r', 16)} {of_tile(16)}")
def pyramid_descent_polys(spark, d):
    """Every vertex of large triangles with holes in all tiles of zooms 0 to 4 that they meet, found by descent."""
    made = ft.from_vertices(fx.view(spark, d, fx.TRIANGLES), g.POLYGON, "ring", "ext")
    e = TileEngine(spark, Source("triangles", made, Options(tolerance=0), id_col="fid"))
    return read_pieces(e.pyramid_pieces(0, 4, empty=False), FEATURES, PATHS, paths)


@query("mvt_line_paths", f"""with recursive {T}, {BOXES}, {FEATURE_BOXES['lines']},
k as (select b.fid, z, x as tx, y as ty from b join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1),
src as (select ((l.fid*8+z)*8+tx)*8+ty as fid, 0 as ring, l.vtx, {PX}*power(2,z)-tx as x, {PY}*power(2,z)-ty as y from l join k on l.fid=k.fid),
{slab('src', 'c1', -0.015625, 1.015625, 'x', False)}, {slab('c1', 'c2', -0.015625, 1.015625, 'y', False)},
box as (select fid, ring, (max(x)-min(x))*(max(y)-min(y)) as area, count(*) over (partition by fid) as rings from c2 group by fid, ring),
v as materialized (select c2.fid*1000+c2.ring as fid, vtx, x, y from c2 join box on box.fid=c2.fid and box.ring=c2.ring where rings=1 or area>={TILE_TOL}),
{splits(TILE_TOL)},
w as (select v.fid//1000 as fid, v.fid%1000 as ring, v.vtx, cast(floor(4096*v.x+0.5) as bigint) as x, cast(floor(4096*v.y+0.5) as bigint) as y from v join kept_vtx using (fid, vtx)),
out as (select fid, dense_rank() over (partition by fid order by ring)-1 as k, row_number() over (partition by fid, ring order by vtx)-1 as vtx, x, y from w)
{of_tile(8, 2)}""")
def mvt_line_paths(spark, d):
    """Every vertex of every line in every tile of the grid, as decoded: clipped, simplified by 3 units and encoded."""
    made = engine(spark, d, ("lines",), Behaviour(ties="nearest")).pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])
    return read_pieces(made, FEATURES, PATHS, paths)


@query("mvt_three_layers", f"""with {T}, {BOXES}, {FEATURE_BOXES['points']}, {FEATURE_BOXES['polys'].replace('b as', 'b2 as')},
pt as (select z,x,y,p.* from p join b on p.fid=b.fid join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1),
vals as (select z,x,y, 's'||status as v from pt union select z,x,y,'s'||priority from pt union select z,x,y,'n'||cast(cust as varchar) from pt
  union select z,x,y,case when price=floor(price) then 'n'||cast(cast(price as bigint) as varchar) else 'd'||cast(price as varchar) end from pt),
a as (select z,x,y,count(*) as n, cast(sum(fid) as bigint) as fids from pt group by z,x,y), av as (select z,x,y,count(*) as v from vals group by z,x,y),
s as (select z,x,y,count(distinct status) as v from pt group by z,x,y),
c as (select z,x,y,count(*) as n, cast(sum(fid) as bigint) as fids from b2 join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1 where z>=2 group by z,x,y)
select t.z,t.x,t.y,0 as ord,'points' as name,4096 as extent,coalesce(n,0) as n,coalesce(fids,0) as fids,case when n>0 then 'status,priority,price,cust' else '' end as keys,coalesce(v,0) as "values" from t left join a using (z,x,y) left join av using (z,x,y)
union all select t.z,t.x,t.y,1,'polys',4096,coalesce(n,0),coalesce(fids,0),'',0 from t left join c using (z,x,y)
union all select t.z,t.x,t.y,2,'coarse',512,coalesce(n,0),coalesce(fids,0),case when n>0 then 'status' else '' end,coalesce(v,0) from t left join a using (z,x,y) left join s using (z,x,y)""")
def mvt_three_layers(spark, d):
    """Layers of every tile of the grid as its bytes have them: order, names, extents, features, keys and how many
    values; polygons begin at zoom 2, so their layers above are empty."""
    p = points(spark, d)
    e = TileEngine(spark, [Source("points", p, id_col="fid"), Source("polys", polys(spark, d), Options(min_zoom=2), id_col="fid"), Source("coarse", p, Options(extent=512), ("status",), id_col="fid")], Options(tolerance=0))
    named = e.named()

    def told(b):  # a row for each piece
        for raw, section in zip(b.column("bytes"), b.column("section").to_pylist(), strict=True):
            ids = pbf.features(raw.as_buffer()).id if section == FEATURES else []
            found = pbf.items(raw.as_py()) if section in (KEYS, VALUES) else []
            yield len(raw.as_buffer()), len(ids), int(np.sum(ids)), found if section == KEYS else [], len(found) * (section == VALUES)

    def run(batches):
        for b in batches:
            cols = [pa.array(c, t) for c, t in zip(zip(*told(b), strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("z", "x", "y", "ord", "first")), *cols], names=["z", "x", "y", "ord", "first", "size", "n", "fids", "keys", "values"])

    pieces = e.pieces(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])
    pieces = stored(pieces.mapInArrow(run, "z int, x long, y long, ord int, first long, size long, n long, fids long, keys array<string>, `values` long"), "pieces-told")
    heads = read_pieces(tiles.heads(pieces, named), HEADS, "ord int, name string, extent int", lambda raw, first, o: ([o], *([v] for v in pbf.layer_head(raw.to_pybytes()))))
    at = ["z", "x", "y", "ord"]
    keys = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "keys"))), lambda s: s["keys"]))
    found = pieces.groupBy(at).agg(*(F.sum(c).alias(c) for c in ("n", "fids", "values")), F.array_join(keys, ",").alias("keys"))
    none = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "fids", "values")}
    return heads.join(found, at, "left").select(*at, "name", "extent", none["n"], none["fids"], F.coalesce("keys", F.lit("")).alias("keys"), none["values"])


MERGE = """with r as (select o_custkey%16 as path, o_orderkey*700 as off, 100+o_orderkey%150 as len from orders),
e as (select *, max(off+len) over (partition by path order by off, len rows between unbounded preceding and 1 preceding) as e from r),
i as (select *, sum(case when e is null or off>e+6000 then 1 else 0 end) over (partition by path order by off, len rows unbounded preceding) as isle from e)
select path, min(off) as "offset", max(off+len)-min(off) as length from i group by path, isle"""


@query("index_range_merge", MERGE)
def index_range_merge(spark, d):
    """A range of every order; orders of other paths make the gaps."""
    return merged_orders(fx.table(spark, d, "orders"))


def merged_orders(o: DataFrame) -> DataFrame:
    r = o.select((F.col("o_custkey") % 16).alias("path"), (F.col("o_orderkey") * 700).alias("offset"), (F.lit(100) + F.col("o_orderkey") % 150).alias("length"))
    return ranges.merge_ranges(r, 6000)


LEVELS = """with recursive s as (select p_partkey as n from part), l(n, level, nodes) as (select n, 0, n from s union all select n, level+1, (nodes+15)//16 from l where nodes>1 or level=0)
select n, level, cast(coalesce(sum(nodes) over (partition by n order by level desc rows between unbounded preceding and 1 preceding),0) as bigint) as first, cast(sum(nodes) over (partition by n order by level desc rows unbounded preceding) as bigint) as last from l"""


@query("rtree_level_bounds", LEVELS)
def rtree_level_bounds(spark, d):
    """Trees of as many features as each key of part says."""
    return level_bounds(fx.table(spark, d, "part").select("p_partkey"))


def level_bounds(keys: DataFrame) -> DataFrame:
    @F.arrow_udf("array<struct<level:int,first:bigint,last:bigint>>")
    def bounds(n: pa.Array) -> pa.Array:
        return pa.array([[{"level": i, "first": a, "last": b} for i, (a, b) in enumerate(flatgeobuf.levels(v, 16))] for v in n.to_pylist()], pa.list_(pa.struct([("level", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])))

    return keys.select(F.col("p_partkey").alias("n"), F.explode(bounds("p_partkey")).alias("l")).select("n", "l.level", "l.first", "l.last")


@query("tile_pbf_sizes")
def tile_pbf_sizes(spark, d):
    return engine(spark, d, ("points", "lines", "polys")).sizes(fx.view(spark, d, fx.TILES), few=False, zooms=[0, 1, 2, 3])


@query("flagship_tile_pyramid")
def flagship_tile_pyramid(spark, d):
    """Three sources, all tiles of zooms 0 to 4."""
    e = engine(spark, d, ("points", "lines", "polys"))
    return e.pyramid_digests(0, 4)


def parts_file(spark, d) -> str:
    """Polygons written to a file with an index, by all tasks."""
    path = local_scratch(spark, "parts") + ".fgb"
    base = polys(spark, d).join(fx.table(spark, d, "part").select(F.col("p_partkey").alias("fid"), "p_brand", "p_size"), "fid")
    named = base.select("geom_type", "rings", *ft.BOX, F.col("fid").alias("pk"), F.col("p_brand").alias("brand"), F.col("p_size").cast("int").alias("size"))
    flatgeobuf.write_frame(named, path, [("pk", "long"), ("brand", "string"), ("size", "int")])
    return path


@query("fgb_roundtrip_scan", f"with {G} select fid, cast(count(*) as bigint) as vertices, count(distinct ring) as rings, count(distinct case when ext then ring end) as exteriors, round(sum(lon),6) as sx, round(sum(lat),6) as sy, any_value(p_brand) as brand, any_value(p_size) as size from g join part on fid=p_partkey where lon is not null group by fid having max(lon)>=-60.5 and min(lon)<=45.25 and max(lat)>=-30 and min(lat)<=41.5")
def fgb_roundtrip_scan(spark, d):
    """Polygons written to a file and read back through its index."""
    back = flatgeobuf.read(spark, parts_file(spark, d)).where("maxx >= -60.5 and minx <= 45.25 and maxy >= -30 and miny <= 41.5")
    v = g.all_points(F.col("rings"))
    add = lambda c: F.aggregate(F.transform(v, lambda p: p[c]), F.lit(0.0), lambda a, b: a + b)
    return back.select(F.col("pk").alias("fid"), F.size(v).cast("long").alias("vertices"), F.size("rings").cast("long").alias("rings"), F.size(F.filter("rings", lambda r: r["ext"])).cast("long").alias("exteriors"), F.round(add("x"), 6).alias("sx"), F.round(add("y"), 6).alias("sy"), "brand", "size")


@query("tile_from_fgb_index", f"with {FEATURE_BOXES['polys']}, t as (select 3 as z, 4 as x, 3 as y), {BOXES} select fid, p_brand as brand, p_size as size from b join part on fid=p_partkey join tb on minx<=w2 and maxx>=w0 and miny<=w3 and maxy>=w1")
def tile_from_fgb_index(spark, d):
    """One tile from a file: its box goes to the file's index, and features come from the tile's bytes."""
    e = TileEngine(spark, Source("parts", parts_file(spark, d), Options(tolerance=0), id_col="pk"))
    return decoded(e.tile_list([(3, 4, 3)]), "fid long, brand string, size int", lambda z, x, y, ls: [(f["id"], f["properties"]["brand"], f["properties"]["size"]) for f in ls[0]["features"]])


@query("streaming_tile_density", """with e as (select ts, ((user_id*3571)%300)-150 as lon, ((user_id*2309)%120)-60 as lat, value from events)
select date_trunc('day', ts) as day, cast(floor((lon/360e0+0.5e0)*8) as bigint) as x, cast(floor((0.5e0-0.25e0*ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/pi())*8) as bigint) as y, count(*) as n from e group by 1,2,3""")
def streaming_tile_density(spark, d):
    from tilespark.streaming.density import density_of_files

    return density_of_files(spark, f"{d}/events.parquet")
