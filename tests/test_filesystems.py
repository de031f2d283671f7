"""Readers with pooled handles, options of S3-style stores, and the tile sink's commits."""

import os
import pickle
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest

from tilespark.sources import tilefiles
from tilespark.sources.filesystems import FileSystemReader, file_system, s3_arguments
from tilespark.sources.ranges import reader_for

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_options_of_stores():
    assert s3_arguments({}) == {}
    keys = {"access_key": "who", "secret_key": "what", "session_token": "until"}
    assert s3_arguments(keys) == keys
    assert s3_arguments({"endpoint": "http://store:9000/"}) == {"endpoint_override": "store:9000", "scheme": "http"}
    assert s3_arguments({"endpoint": "store"}) == {"endpoint_override": "store"}
    assert s3_arguments({"region": "eu-north-1", "path_style": "false", "anonymous": "True"}) == {"region": "eu-north-1", "force_virtual_addressing": True, "anonymous": True}
    for wrong in ({"access_key": "who"}, {"secret_key": "what"}, {"session_token": "until"}):
        with pytest.raises(ValueError, match="go"):
            s3_arguments(wrong)
    system, at = file_system("s3a://bucket/some/key", {**keys, "region": "eu-north-1", "endpoint": "https://store:1"})
    made = system.__reduce__()[1][0]
    assert at == "bucket/some/key" and made["session_token"] == "until" and made["access_key"] == "who" and made["endpoint_override"] == "store:1"
    assert reader_for("s3://b/k").concurrency == 10 and reader_for("s3://b/k", {"concurrency": "3", "open_files": "5"}).open_files == 5


def test_ranges_of_pooled_handles(tmp_path):
    raw = bytes(range(250))
    for i in range(9):
        (tmp_path / f"f{i}").write_bytes(raw + bytes([i]))
    r = FileSystemReader(open_files=3)
    for i in [*range(9), 0, 8]:
        assert r.read(f"{tmp_path}/f{i}", 248, 10) == bytes([248, 249, i])
        assert len(r.handles) <= 3
    kept = list(r.handles.values())
    assert r.read(f"file://{tmp_path}/f8", 5, -1) == raw[5:] + b"\x08" and r.read(f"{tmp_path}/f8", 251, 4) == b"" and r.read(f"{tmp_path}/f8", 400, -1) == b""
    r.close()
    assert not r.handles and all(h.closed for h in kept)
    assert r.read(f"{tmp_path}/f1", 0, 2) == b"\x00\x01"  # opens again
    again = pickle.loads(pickle.dumps(r))
    assert again.open_files == 3 and not again.handles and again.read(f"{tmp_path}/f1", 1, 1) == b"\x01"


def test_changed_files_are_opened_anew(tmp_path):
    f = tmp_path / "f"
    f.write_bytes(b"old")
    r = FileSystemReader()
    assert r.read(str(f), 0, -1) == b"old"
    (tmp_path / "g").write_bytes(b"newer")
    os.replace(tmp_path / "g", f)
    assert r.read(str(f), 0, -1) == b"newer" and len(r.handles) == 1
    with pytest.raises(FileNotFoundError):
        r.read(str(tmp_path / "none"), 0, 1)


def test_threads_share_few_handles(tmp_path):
    for i in range(20):
        (tmp_path / f"f{i}").write_bytes(bytes([i]) * 100)
    r = FileSystemReader(open_files=2, concurrency=8)
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda k: r.read(f"{tmp_path}/f{k % 20}", k % 90, 10), range(2000)))
    assert got == [bytes([k % 20]) * 10 for k in range(2000)]
    r.read(f"{tmp_path}/f0", 0, 1)
    assert len(r.handles) <= 2 and not any(r.used.values())


def tiles(*rows):
    z, x, y, pbf = zip(*rows, strict=True)
    return iter([pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(pbf, pa.binary())], names=["z", "x", "y", "pbf"])])


def written(top):
    return {str(p.relative_to(top)): p.read_bytes() for p in top.rglob("*") if p.is_file()}


def test_only_attempts_that_succeed_are_moved(tmp_path):
    w = tilefiles.Writer({"path": str(tmp_path)}, False)
    w.write(tiles((1, 0, 0, b"lost"), (1, 1, 1, b"stray")))
    m = pickle.loads(pickle.dumps(w)).write(tiles((1, 0, 0, b"kept"), (2, 3, 3, None)))
    with pytest.raises(ValueError, match="without"):
        w.write(tiles((1, None, 0, b"x")))
    assert not [p for p in tmp_path.rglob("*.pbf") if "_writing" not in str(p)]
    w.commit([m, None])
    assert written(tmp_path) == {"1/0/0.pbf": b"kept", "2/3/3.pbf": b""}
    w = tilefiles.Writer({"path": str(tmp_path), "skip_empty": "true"}, False)
    w.commit([w.write(tiles((1, 0, 0, b"newer"), (5, 0, 0, b"")))])
    assert written(tmp_path) == {"1/0/0.pbf": b"newer", "2/3/3.pbf": b""}
    w = tilefiles.Writer({"path": str(tmp_path)}, False)
    w.write(tiles((7, 0, 0, b"x")))
    w.abort([None])
    assert "7/0/0.pbf" not in written(tmp_path) and not list(tmp_path.glob("_writing*"))


def test_overwrite_and_failing_jobs(spark, tmp_path):
    tilefiles.register(spark)
    rows = spark.range(40).selectExpr("6 z", "id div 8 x", "id % 8 y", "cast(cast(id as string) as binary) pbf").selectExpr("cast(z as int) z", "x", "y", "pbf")
    save = lambda df, mode: df.write.format("tilefiles").mode(mode).option("path", str(tmp_path / "t")).save()
    save(rows.repartition(5), "append")
    first = written(tmp_path / "t")
    assert first == {f"6/{i // 8}/{i % 8}.pbf": str(i).encode() for i in range(40)}
    (tmp_path / "t/readme.txt").write_text("mine")
    bad = rows.repartition(3).selectExpr("z", "x", "y", "if(x = 4 and y = 7, cast(raise_error('no') as binary), cast('new' as binary)) pbf")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            save(bad, mode)
        assert written(tmp_path / "t") == first | {"readme.txt": b"mine"}
    save(rows.where("x = 1 and y < 2"), "overwrite")
    assert written(tmp_path / "t") == {"6/1/0.pbf": b"8", "6/1/1.pbf": b"9", "readme.txt": b"mine"}


KILLED = """
import os, sys, signal
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from tilespark.sources import tilefiles
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
tilefiles.register(spark)
mark = sys.argv[2] + ".killed"

def once(batches):
    for b in batches:
        yield b
    if b.column("z")[0].as_py() and not os.path.exists(mark):
        open(mark, "w").close()
        os.kill(os.getpid(), signal.SIGKILL)

rows = spark.range(0, 60, 1, 3).selectExpr("cast(6 as int) z", "id div 8 x", "id % 8 y", "cast(cast(id as string) as binary) pbf")
rows.mapInArrow(once, rows.schema).write.format("tilefiles").mode("append").option("path", sys.argv[2]).save()
"""


def test_a_killed_task_loses_and_leaves_nothing(tmp_path):
    (tmp_path / "job.py").write_text(KILLED)
    subprocess.run([sys.executable, str(tmp_path / "job.py"), HERE, str(tmp_path / "t")], check=True, timeout=150, capture_output=True, env={**os.environ, "PYTHONPATH": HERE})
    assert (tmp_path / "t.killed").exists()
    assert written(tmp_path / "t") == {f"6/{i // 8}/{i % 8}.pbf": str(i).encode() for i in range(60)}
    assert not list((tmp_path / "t").glob("_writing*"))
