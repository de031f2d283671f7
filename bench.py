"""Prints one JSON line: seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], the median of
three runs in a warm session, and the features a second of the kernels that the baseline publishes."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ("project_points", "quantize_points", "encode_point_commands", "tile_cover_join_points_cells", "clip_polygon_box", "simplify_lines_z6", "encode_polygon_commands", "tile_layer_counts", "mvt_roundtrip_points", "tile_pbf_sizes", "flagship_tile_pyramid")


def kernel_rates() -> dict[str, float]:
    """Of one core, on arrays in memory, as the baseline measures: its unit of work a second."""
    from tilespark.functions import kernels as k
    from tilespark.functions.layers import Assembler

    rng = np.random.default_rng(1)

    def rate(work, units: int, least: float = 0.5) -> float:
        work()
        n, t = 0, time.perf_counter()
        while (d := time.perf_counter() - t) < least:
            work()
            n += units
        return n / d

    def batch(features: int, vertices: int, spread: float) -> k.Rings:
        a = np.linspace(0, 2 * np.pi, vertices)
        xy = rng.random((features, 1, 2)) + spread * np.stack([np.cos(a), np.sin(a)], 1) * (1 + 0.2 * rng.random((features, vertices, 1)))
        xy[:, -1] = xy[:, 0]
        v = xy.reshape(-1, 2)
        return k.Rings(v[:, 0].copy(), v[:, 1].copy(), np.arange(features + 1) * vertices, np.arange(features), np.ones(features, bool))

    polys, lines = batch(20_000, 20, 0.05), batch(5_000, 200, 0.05)
    box = tuple(np.full(20_000, v) for v in (0.2, 0.2, 0.8, 0.8))
    yes, no = np.ones(20_000, bool), np.zeros(5_000, bool)
    whole = k.Rings((lines.x * 4096).astype(np.int64), (lines.y * 4096).astype(np.int64), lines.ring, lines.feat, lines.ext)
    # layers of 100 points with two properties, as they reach a tile's task
    per, count = 100, 1000
    texts = [t for i in range(per) for t in ("spoint", f"u{i}")] * count
    cmds = np.stack([np.full(per * count, 9), *(rng.integers(0, 8192, per * count) for _ in range(2))], 1)
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(per * count, 14, np.int32)), pa.array(np.repeat(np.arange(count), per)), pa.array(np.zeros(per * count, np.int64)), pa.array(np.zeros(per * count, np.int32)),
            pa.array(np.ones(per * count, np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * per * count + 1, 3, dtype=np.int32)), pa.array(cmds.ravel())),
            pa.array([b""] * per * count, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * per * count + 1, 2, dtype=np.int32)), pa.array(texts)), pa.nulls(per * count, pa.int64()),
        ],
        names=["z", "x", "y", "ord", "kind", "cmds", "geom", "vals", "id"],
    )

    def layers():
        a = Assembler([("l", 4096, ["name", "value"])])
        n = sum(1 for lo in range(0, rows.num_rows, 10_000) for _ in a.feed(rows.slice(lo, 10_000))) + sum(1 for _ in a.finish())
        assert n == count

    return {
        "clip_polygons_per_s": rate(lambda: k.clip(polys, box, yes), 20_000),
        "simplify_vertices_per_s": rate(lambda: k.simplify(lines, np.full(5_000, 1e-6)), 1_000_000),
        "encode_vertices_per_s": rate(lambda: k.encode(whole, no, 5_000), 1_000_000),
        "pbf_features_per_s": rate(layers, 100_000),
    }


def projection_rate(spark: SparkSession, rows: int = 40_000_000) -> float:
    """Coordinates a second and core through the engine's own projection, in a table that Spark makes."""
    from pyspark.sql import functions as F

    from tilespark.functions import tilemath as tm

    made = spark.range(0, rows, 1, int(CPUS)).select((F.col("id") % 360 - 180.5).alias("lon"), (F.col("id") % 170 - 84.5).alias("lat"))
    took = []
    for _ in range(3):
        t = time.perf_counter()
        made.select(tm.project_x("lon").alias("x"), tm.project_y("lat").alias("y")).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - t)
    return rows / min(took) / int(CPUS)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tilespark.plans.queries import QUERIES

    took = {}
    for name in HEADLINES:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs[1:]), 3)
    projected = projection_rate(spark)
    spark.stop()
    rates = {n: round(v) for n, v in {"project_coords_per_s": projected, **kernel_rates()}.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS), "one_core": rates}))


if __name__ == "__main__":
    main()
