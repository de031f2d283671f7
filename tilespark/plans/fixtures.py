"""Geometry derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

POINTS = """select o_orderkey as fid, ((o_orderkey*7919)%360000)/1e3-180 as lon, ((o_orderkey*104729)%170000)/1e3-85 as lat,
       o_orderstatus as status, o_orderpriority as priority, o_totalprice as price, o_custkey as cust
from orders"""

LINES = """select user_id as fid, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as vtx,
       ((user_id*3571)%300)-150 + (row_number() over (partition by user_id order by ts, event_id)-1)*1e-2 as lon,
       ((user_id*2309)%120)-60 + value/1e3 as lat
from events"""

POLYS = """with c as (select p_partkey as fid, ((p_partkey*7919)%340000)/1e3-170 as cx, ((p_partkey*104729)%150000)/1e3-75 as cy,
                  p_size/1e2 as h, p_size from part),
r as (select fid,0 as ring,true as ext,cx,cy,h from c
      union all select fid,1,false,cx,cy,h/2 from c where p_size>25
      union all select fid,2,true,cx+3*h,cy,h from c where p_size%10=0),
v as (select 0 as vtx,-1 as sx,-1 as sy union all select 1,1,-1 union all select 2,1,1
      union all select 3,-1,1 union all select 4,-1,-1)
select fid,ring,ext,vtx,cx+sx*h as lon,cy+sy*h as lat from r cross join v"""

#: Large triangles with a hole of half their size, from a corner of the world to another.
TRIANGLES = """with c as (select c_custkey as fid, ((c_custkey*7919)%340000)/1e3-170 as x1, ((c_custkey*104729)%150000)/1e3-75 as y1,
                  ((c_custkey*31337)%340000)/1e3-170 as x2, ((c_custkey*15485863)%150000)/1e3-75 as y2,
                  ((c_custkey*1299709)%340000)/1e3-170 as x3, ((c_custkey*3571)%150000)/1e3-75 as y3 from customer),
p as (select fid,0 as k,x1 as lon,y1 as lat from c union all select fid,1,x2,y2 from c union all select fid,2,x3,y3 from c union all select fid,3,x1,y1 from c),
m as (select fid,(x1+x2+x3)/3e0 as mx,(y1+y2+y3)/3e0 as my from c)
select fid,0 as ring,true as ext,k as vtx,cast(lon as double) as lon,cast(lat as double) as lat from p
union all select p.fid,1,false,k,mx+(lon-mx)*5e-1,my+(lat-my)*5e-1 from p join m on p.fid=m.fid"""

TILES = """with zz as (select 0 as z union all select 1 union all select 2 union all select 3),
a as (select z, cast(power(2,z) as int) as n from zz),
i as (select row_number() over (order by p_partkey)-1 as k from part where p_partkey<=64)
select z, cast(x.k as bigint) as x, cast(y.k as bigint) as y from a join i x on x.k<n join i y on y.k<n"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A fixture over the tables of sf_dir."""
    for name in ("orders", "events", "part", "customer"):
        if f" {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)
