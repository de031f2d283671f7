"""Queries over whole tables against brute force, beside those whose SQL takes a part."""

import os

import pyarrow.parquet as pq
import pytest

from tilespark.plans.queries import ORACLE, QUERIES, level_bounds

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables here")


def from_sql(name):
    con = pytest.importorskip("duckdb").connect()
    for t in os.listdir(D):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    return sorted(con.execute(ORACLE[name]).fetchall())


def test_ranges_of_all_orders(spark):
    islands = {}
    rows = pq.read_table(f"{D}/orders.parquet").to_pylist()
    for path, off, n in sorted((r["o_custkey"] % 16, r["o_orderkey"] * 700, 100 + r["o_orderkey"] % 150) for r in rows):
        found = islands.setdefault(path, [])
        if found and off <= found[-1][1] + 6000:
            found[-1][1] = max(found[-1][1], off + n)
        else:
            found.append([off, off + n])
    want = sorted((p, a, b - a) for p, x in islands.items() for a, b in x)
    got = sorted(map(tuple, QUERIES["index_range_merge"](spark, D).select("path", "offset", "length").collect()))
    assert got == want == from_sql("index_range_merge")
    assert 16 < len(got) < len(rows)  # some meet, some stay apart
    assert sum(a <= r["o_orderkey"] * 700 < a + n for r in rows for p, a, n in got if p == r["o_custkey"] % 16) == len(rows)


def test_levels_of_all_trees(spark):
    want, keys = [], pq.read_table(f"{D}/part.parquet").column("p_partkey").to_pylist()
    keys += [4096, 4097, 20_000, 65_537]  # beyond the smallest table: four, five and six levels
    for n in keys:
        sizes = [n]
        while sizes[-1] > 1 or len(sizes) == 1:
            sizes.append(sizes[-1] // 16 + (sizes[-1] % 16 > 0))
        want += [(n, i, sum(sizes[i + 1 :]), sum(sizes[i:])) for i in range(len(sizes))]
    of_table = {n for n in keys[:-4]}
    got = sorted(map(tuple, QUERIES["rtree_level_bounds"](spark, D).collect()))
    assert got == sorted(w for w in want if w[0] in of_table) == from_sql("rtree_level_bounds")
    large = level_bounds(spark.createDataFrame([(n,) for n in keys[-4:]], "p_partkey long"))
    assert sorted(map(tuple, large.collect())) == sorted(w for w in want if w[0] not in of_table)


@pytest.mark.parametrize("name", ["multi_source_layers", "mvt_roundtrip_points"])
def test_every_tile_of_the_grid(spark, name):
    df = QUERIES[name](spark, D)
    con = pytest.importorskip("duckdb").connect()
    for t in os.listdir(D):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{D}/{t}'")
    want = sorted(con.execute(f"select {', '.join(df.columns)} from ({ORACLE[name]})").fetchall())
    assert sorted(map(tuple, df.collect())) == want and {w[0] for w in want} == {0, 1, 2, 3}
