"""A sink for tiles: {z}/{x}/{y}.pbf files under a folder of any file system (see filesystems.file_system).

    register(spark); tiles.write.format("tilefiles").mode("append").option("path", folder).save()

All tiles of a write appear when it commits, or none: each attempt of a task writes to a folder of its own below
`_writing-<job>`; the commit moves the files of those attempts that succeeded, and what lost, repeated or failed
attempts left goes with that folder. Mode overwrite removes the zoom folders that were there, after all tasks have
succeeded. A commit that is cut off leaves its folder, and each tile is either the old or the new one, whole.

Empty tiles are written unless skip_empty is set; a null pbf is an empty tile, tiles without numbers raise. Of rows
for one tile any one stays. Other options are those of the file system.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tilespark.sources.filesystems import file_system

#: Files that a commit moves at once.
MOVES = 32
#: How often the removal of a job's folder is tried.
CLEARINGS = 20


@dataclass
class Written(WriterCommitMessage):
    attempt: str
    files: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.skip_empty = options.get("skip_empty", "false").lower() == "true"
        self.job = f"_writing-{uuid.uuid4().hex}"
        system, folder = self.place()
        system.create_dir(f"{folder}/{self.job}", recursive=True)

    def place(self) -> tuple[fs.FileSystem, str]:
        return file_system(self.options["path"], self.options)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = self.place()
        attempt, n, made = f"{folder}/{self.job}/{uuid.uuid4().hex}", 0, set()
        # the job's folder is never made here: a task that outlives the job's abort fails for want of it
        system.create_dir(attempt, recursive=False)
        for b in batches:
            z, x, y = (b.column(c).to_pylist() for c in ("z", "x", "y"))
            for k, body in enumerate(b.column("pbf")):
                size = body.as_buffer() if body.is_valid else pa.py_buffer(b"")
                if self.skip_empty and not size.size:
                    continue
                if None in (z[k], x[k], y[k]):
                    raise ValueError("a tile without z, x or y")
                at = f"{attempt}/{z[k]}/{x[k]}"
                for d in (f"{attempt}/{z[k]}", at):
                    if d not in made:
                        system.create_dir(d, recursive=False)
                        made.add(d)
                with system.open_output_stream(f"{at}/{y[k]}.pbf") as f:
                    f.write(size)
                n += 1
        return Written(attempt, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, folder = self.place()
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.type == fs.FileType.Directory and old.base_name.isdigit():
                    system.delete_dir(old.path)
        with ThreadPoolExecutor(MOVES) as pool:
            for m in messages:
                if m is None or not m.files:
                    continue
                for zoom in system.get_file_info(fs.FileSelector(m.attempt)):
                    for column in system.get_file_info(fs.FileSelector(zoom.path)):  # one column's names at a time
                        to = f"{folder}/{zoom.base_name}/{column.base_name}"
                        system.create_dir(to, recursive=True)
                        list(pool.map(lambda f, to=to: system.move(f.path, f"{to}/{f.base_name}"), system.get_file_info(fs.FileSelector(column.path))))
        self.clear(system, folder)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.clear(*self.place())

    def clear(self, system: fs.FileSystem, folder: str) -> None:
        for left in range(CLEARINGS, 0, -1):  # tasks that are being stopped may write while it is removed
            try:
                if system.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
                    system.delete_dir(f"{folder}/{self.job}")
                return
            except OSError:
                if left == 1:
                    raise
                time.sleep(0.2)


class TileFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tilefiles"

    def schema(self) -> str:
        return "z int, x bigint, y bigint, pbf binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TileFiles)
