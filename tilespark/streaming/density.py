"""Counts of streamed events by tile and time, late events included up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import tilemath as tm
from tilespark.sources.shared import scratch


def density(stream: DataFrame, z: int, ts: str = "ts", lon: str = "lon", lat: str = "lat", every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Windowed counts of a stream with coordinates."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), tm.tile_of(tm.project_x(lon), F.lit(z)).alias("x"), tm.tile_of(tm.project_y(lat), F.lit(z)).alias("y")).agg(F.count("*").alias("n"))


def density_of_files(spark: SparkSession, path: str, z: int = 3) -> DataFrame:
    """All events of a Parquet table, run as a stream to its end. Updates go to the shared folder; the last
    one of each window and tile counts."""
    at = scratch(spark, "density")
    schema = spark.read.parquet(path).schema
    # a glob that names the table itself, be it a file or a folder
    events = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    events = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 3571 % 300 - 150).alias("lon"), (F.col("user_id") * 2309 % 120 - 60).alias("lat"))

    def emit(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")

    q = density(events, z).writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").foreachBatch(emit).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{at}/out")
    return out.groupBy(F.col("w.start").cast("timestamp_ntz").alias("day"), "x", "y").agg(F.max("n").alias("n"))
