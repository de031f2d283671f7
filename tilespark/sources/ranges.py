"""Byte ranges: readers over local files, HTTP and S3-style stores, and merging of near ranges."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.sources.shared import stored

#: Ranges at most so many bytes apart are read as one.
GAP = 512


class RangeReader(ABC):
    """Reads byte ranges of one store. close() may be called twice; a closed reader opens again on use."""

    concurrency = 1

    @abstractmethod
    def read(self, path: str, offset: int, length: int) -> bytes:
        """The bytes there, fewer at the end of the file; a length of -1 reads to the end."""

    def read_ranges(self, path: str, ranges: list[tuple[int, int]]) -> list[bytes]:
        """Several ranges, in their order, `concurrency` at a time."""
        if self.concurrency <= 1 or len(ranges) < 2:
            return [self.read(path, o, n) for o, n in ranges]
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(lambda r: self.read(path, *r), ranges))

    def close(self) -> None:
        return None


def header(offset: int, length: int) -> str:
    return f"bytes={offset}-{'' if length < 0 else offset + length - 1}"


@dataclass
class HttpReader(RangeReader):
    """Range requests with retries: server errors, 429 and failed connections are tried again after 0.2, 0.4,
    0.8, ... seconds; other refusals fail at once. A server that ignores ranges has the range cut out of
    its whole answer."""

    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    concurrency: int = 6
    retries: int = 3
    backoff: float = 0.2

    def read(self, path: str, offset: int, length: int) -> bytes:
        request = urllib.request.Request(path, headers={**self.headers, "Range": header(offset, length)})
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    body = r.read()
                    body = body[offset:] if r.status == 200 else body
                    return body if length < 0 else body[:length]
            except urllib.error.HTTPError as e:
                if e.code == 416:  # beyond the end
                    return b""
                if attempt == self.retries or e.code < 500 and e.code != 429:
                    raise
            except OSError:
                if attempt == self.retries:
                    raise
            time.sleep(self.backoff * 2**attempt)
        raise AssertionError


def s3_location(path: str) -> tuple[str, str]:
    """Bucket and key of s3://bucket/key or bucket/key."""
    bucket, _, key = path.removeprefix("s3://").removeprefix("s3a://").removeprefix("s3n://").partition("/")
    if not bucket or not key:
        raise ValueError(f"not a bucket and key: {path!r}")
    return bucket, key


@dataclass
class S3Reader(RangeReader):
    """Range reads through a client with get_object(Bucket, Key, Range), which the caller brings: its region,
    credentials, endpoint and path style are the client's. The body may be bytes, a file, or an iterable."""

    client: object
    concurrency: int = 10

    def read(self, path: str, offset: int, length: int) -> bytes:
        bucket, key = s3_location(path)
        body = self.client.get_object(Bucket=bucket, Key=key, Range=header(offset, length))["Body"]
        if isinstance(body, bytes | bytearray):
            return bytes(body)
        return body.read() if hasattr(body, "read") else b"".join(body)


def s3a_settings(endpoint: str | None = None, region: str | None = None, path_style: bool = False, access_key: str | None = None, secret_key: str | None = None, session_token: str | None = None) -> dict[str, str]:
    """Spark settings for reading the same stores through Hadoop's s3a file system."""
    found = {"endpoint": endpoint, "endpoint.region": region, "path.style.access": "true" if path_style else None, "access.key": access_key, "secret.key": secret_key, "session.token": session_token}
    return {f"spark.hadoop.fs.s3a.{k}": v for k, v in found.items() if v is not None}


#: Readers that users add, by scheme.
_registered: dict[str, Callable[[], RangeReader]] = {}


def register_reader(scheme: str, make: Callable[[], RangeReader]) -> None:
    """From now on paths of this scheme (such as `gs`) are read by what make() returns; make is sent to the tasks
    that read."""
    _registered[scheme] = make


def scheme_of(path: str) -> str:
    head, found, _ = path.partition("://")
    return head.lower() if found else ""


def packed_options(path: str, options: dict[str, Any]) -> dict[str, str]:
    """Reader options as the texts that a data source takes. connector: a function without arguments, or a ready
    reader; headers: a dict. Registered readers travel with the options."""
    options = dict(options)
    connector = options.pop("connector", None) or _registered.get(scheme_of(path))
    out = {k: json.dumps(v) if isinstance(v, dict) else str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    if connector is not None:
        out["connector"] = base64.b64encode(cloudpickle.dumps(connector)).decode()
    return out


def reader_for(path: str, options: dict[str, str] | None = None) -> RangeReader:
    """The reader of a path, by its scheme: http(s), registered schemes, or what the library's file systems know
    (local files, s3 with its options, hdfs, gs: see filesystems); or the connector of the options (see packed_options).
    Options of http: headers, timeout, concurrency, retries, backoff; of file systems: concurrency, open_files."""
    from tilespark.sources.filesystems import FileSystemReader

    o = options or {}
    scheme = scheme_of(path)
    if "connector" in o:
        made = cloudpickle.loads(base64.b64decode(o["connector"]))
        return made if isinstance(made, RangeReader) else made()
    if scheme in _registered:
        return _registered[scheme]()
    if scheme in ("http", "https"):
        kinds = {"timeout": float, "concurrency": int, "retries": int, "backoff": float}
        return HttpReader(headers=json.loads(o.get("headers", "{}")), **{k: f(o[k]) for k, f in kinds.items() if k in o})
    if scheme not in ("", "file", "s3", "s3a", "s3n", "hdfs", "viewfs", "gs", "gcs"):
        raise ValueError(f"no reader for {scheme}:// paths: bring a connector or register one")
    usual = {"concurrency": 10 if scheme.startswith("s3") else 1}
    return FileSystemReader(o, **usual | {k: int(o[k]) for k in ("concurrency", "open_files") if k in o})


def merge(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """Sorted (offset, length) ranges with those at most `gap` bytes apart made one."""
    out: list[tuple[int, int]] = []
    for o, n in sorted(ranges):
        if out and o <= out[-1][0] + out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][0] + out[-1][1], o + n) - out[-1][0])
        else:
            out.append((o, n))
    return out


def islands(group: np.ndarray, offset: np.ndarray, end: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Where islands begin among ranges that are sorted by group (numbered upwards) and offset, and where each ends."""
    fresh = np.r_[True, group[1:] != group[:-1]]
    far = pd.Series(end).groupby(group).cummax().to_numpy()
    begin = np.flatnonzero(fresh | np.r_[True, offset[1:] > far[:-1] + gap])
    return begin, np.maximum.reduceat(end, begin) if len(begin) else end


def merge_ranges(df: DataFrame, gap: int = GAP, by: str = "path") -> DataFrame:
    """The same for a table of ranges (by, offset, length): gaps and islands, where a single file may have all ranges.
    Ranges are dealt in order of file and offset, and each task merges its own. How far the ranges of a file reach in
    the tasks before, a row for each task and file, is carried in: what begins within that goes on the last
    island that began before. Files are independent; ranges without an offset or a length are left out."""
    kind = dict(df.dtypes)[by]

    def merged(batches) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # numbers alone, of one task's share
        if not rows.num_rows:
            return
        name = rows.column("by").combine_chunks()
        coded = name.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        group = np.cumsum(np.r_[0, coded[1:] != coded[:-1]])
        at, end = (rows.column(c).to_numpy() for c in ("offset", "end"))
        begin, ends = islands(group, at, end, gap)
        part = np.full(len(begin), TaskContext.get().partitionId(), np.int32)
        yield pa.RecordBatch.from_arrays([name.take(pa.array(begin)), pa.array(part), pa.array(at[begin]), pa.array(ends)], names=["by", "part", "offset", "end"])

    at, size = F.col("offset").cast("long"), F.col("length").cast("long")
    dealt = df.where("offset is not null and length is not null").select(F.col(by).alias("by"), at.alias("offset"), (at + size).alias("end"))
    own = stored(dealt.repartitionByRange("by", "offset", "end").sortWithinPartitions("by", "offset", "end").mapInArrow(merged, f"by {kind}, part int, offset long, end long"), "islands")
    before = Window.partitionBy("by").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    reach = own.groupBy("by", "part").agg(F.max("end").alias("end")).select(F.col("by").alias("b"), F.col("part").alias("p"), F.max("end").over(before).alias("reach"))
    here = (F.col("by").eqNullSafe(F.col("b"))) & (F.col("part") == F.col("p"))
    seen = own.join(reach, here).drop("b", "p").withColumn("fresh", F.col("reach").isNull() | (F.col("offset") > F.col("reach") + gap))
    last = seen.groupBy("by", "part").agg(F.max(F.when(F.col("fresh"), F.col("offset"))).alias("last")).select(F.col("by").alias("b"), F.col("part").alias("p"), F.last("last", True).over(before).alias("open"))
    owned = seen.join(last, here).withColumn("start", F.when(F.col("fresh"), F.col("offset")).otherwise(F.col("open")))
    return owned.groupBy("by", "start").agg(F.max("end").alias("end")).select(F.col("by").alias(by), F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"))
