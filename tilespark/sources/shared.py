"""Tables and files that driver and executors share while a job runs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may do without: there it is a new local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = getattr(spark.sparkContext, "_tilespark_scratch", None) or tempfile.mkdtemp(prefix="tilespark-")
        spark.sparkContext._tilespark_scratch = at
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def local_scratch(spark: SparkSession, name: str) -> str:
    """The same for files that are opened by path."""
    path = scratch(spark, name).removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a lost executor costs nothing of what lies before."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Removes tables that `stored` wrote, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        for f in {os.path.dirname(f) for f in t.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(f)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
