"""FlatGeobuf files: a Python data source that walks the packed R-tree for pushed-down boxes, and a writer.

The header gives the schema. The index is walked level by level, and only nodes whose parents meet the filter are
read: the planner goes down to nodes of some thousands of features and deals these out by number, so what it reads
and sends doesn't grow with features; tasks walk on from there. Near features are read as one range. Features
come back with fid (their number in the index, which is their order in the file), geom_type, rings, their box from the
index, and their properties; with the option layout also with the place of their bytes (byte_at, byte_end).

A file without an index is scanned whole, a step at a time (or gives nothing with strict_index). A feature is as long
as its size says, the last one too. Malformed features are left out (PERMISSIVE) or raise (FAILFAST).
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tilespark.functions import geometry as g
from tilespark.sources.ranges import GAP, RangeReader, packed_options, reader_for

#: Fixed values of the format: first bytes, column types in order, and fields of its tables.
MAGIC = b"fgb\x03fgb"
TYPES = ("byte", "ubyte", "bool", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "string", "json", "datetime", "binary")
FORMATS = {"byte": "b", "ubyte": "B", "bool": "?", "short": "h", "ushort": "H", "int": "i", "uint": "I", "long": "q", "ulong": "Q", "float": "f", "double": "d"}
SPARK = {"byte": "tinyint", "ubyte": "smallint", "bool": "boolean", "short": "smallint", "ushort": "int", "int": "int", "uint": "bigint", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double", "binary": "binary"}
HEADER_ENVELOPE, HEADER_TYPE, HEADER_COLUMNS, HEADER_COUNT, HEADER_NODE = 1, 2, 7, 8, 9
NODE = np.dtype([("minx", "<f8"), ("miny", "<f8"), ("maxx", "<f8"), ("maxy", "<f8"), ("offset", "<u8")])


class Table:
    """A FlatBuffers table: fields by number."""

    def __init__(self, buf: bytes, at: int):
        self.buf, self.at = buf, at
        self.vtable = at - struct.unpack_from("<i", buf, at)[0]
        self.fields = struct.unpack_from("<H", buf, self.vtable)[0] // 2 - 2

    @staticmethod
    def root(buf: bytes) -> Table:
        return Table(buf, struct.unpack_from("<I", buf, 0)[0])

    def place(self, k: int) -> int:
        if k >= self.fields:
            return 0
        o = struct.unpack_from("<H", self.buf, self.vtable + 4 + 2 * k)[0]
        return self.at + o if o else 0

    def scalar(self, k: int, fmt: str, default):
        p = self.place(k)
        return struct.unpack_from("<" + fmt, self.buf, p)[0] if p else default

    def _follow(self, p: int) -> int:
        return p + struct.unpack_from("<I", self.buf, p)[0]

    def vector(self, k: int, dtype: str) -> np.ndarray | None:
        p = self.place(k)
        if not p:
            return None
        v = self._follow(p)
        return np.frombuffer(self.buf, dtype, struct.unpack_from("<I", self.buf, v)[0], v + 4)

    def text(self, k: int, default: str = "") -> str:
        v = self.vector(k, "u1")
        return default if v is None else v.tobytes().decode()

    def tables(self, k: int) -> list[Table]:
        p = self.place(k)
        if not p:
            return []
        v = self._follow(p)
        return [Table(self.buf, self._follow(v + 4 + 4 * i)) for i in range(struct.unpack_from("<I", self.buf, v)[0])]


def levels(count: int, node_size: int, single_root: bool = True) -> list[tuple[int, int]]:
    """(begin, end) of each level's nodes, leaves first; the root stands first in the file. A file of one
    feature has a root above its leaf, unless single_root is off."""
    if node_size < 2:
        raise ValueError("index nodes hold two children at least")
    sizes = [count]
    while sizes[-1] > 1 or single_root and len(sizes) == 1:
        sizes.append(-(-sizes[-1] // node_size))
    out, end = [], sum(sizes)
    for s in sizes:
        out.append((end - s, end))
        end -= s
    return out


@dataclass
class Header:
    geometry_type: int
    columns: list[tuple[str, str]]
    count: int
    node_size: int
    box: tuple[float, ...] | None
    index_at: int
    features_at: int
    single_root: bool = True

    def spark_schema(self, layout: bool = False) -> str:
        place = ", byte_at bigint, byte_end bigint" if layout else ""
        props = "".join(f", `{n}` {SPARK.get(t, 'string')}" for n, t in self.columns)
        return f"fid bigint, geom_type int, rings {g.RINGS}, minx double, miny double, maxx double, maxy double{place}{props}"


#: Headers that this process has read, by path and options.
_headers: dict[tuple, Header] = {}


def header_of(path: str, options: dict | None = None) -> Header:
    """The header of a file, read once in a process for each path (while a local file doesn't change) and options."""
    packed = packed_options(path, options or {})
    local = path.removeprefix("file://")
    state = (os.stat(local).st_mtime_ns, os.path.getsize(local)) if os.path.exists(local) else None
    key = (path, state, tuple(sorted(packed.items())))
    if key not in _headers:
        _headers[key] = read_header(path, packed.get("single_root", "true") == "true", packed)
    return _headers[key]


def forget() -> None:
    """Files are looked at anew."""
    _headers.clear()


def read_header(path: str, single_root: bool = True, options: dict[str, str] | None = None) -> Header:
    r = reader_for(path, options)
    head = r.read(path, 0, 12)
    if len(head) < 8 or head[:7] != MAGIC:
        raise ValueError(f"{path} isn't a FlatGeobuf file")
    if len(head) < 12:
        raise ValueError(f"{path} ends within its header")
    size = struct.unpack_from("<I", head, 8)[0]
    t = Table.root(r.read(path, 12, size))
    box = t.vector(HEADER_ENVELOPE, "<f8")
    r.close()
    columns = [(c.text(0), TYPES[c.scalar(1, "B", 0)]) for c in t.tables(HEADER_COLUMNS)]
    count, node = t.scalar(HEADER_COUNT, "Q", 0), t.scalar(HEADER_NODE, "H", 16)
    index = NODE.itemsize * levels(count, node, single_root)[0][1] if node and count else 0
    return Header(t.scalar(HEADER_TYPE, "B", 0), columns, count, node, tuple(box[:4].tolist()) if box is not None and len(box) >= 4 else None, 12 + size, 12 + size + index, single_root)


Box = tuple[float, float, float, float]


@dataclass
class Walk:
    """A walk down the index of a file, by reads of the nodes that are met."""

    reader: RangeReader
    path: str
    header: Header
    box: Box | None

    def nodes(self, at: np.ndarray) -> np.ndarray:
        """Nodes by number (ascending): neighbours are read as one range."""
        if not len(at):
            return np.zeros(0, NODE)
        cut = np.flatnonzero(np.diff(at) > 1 + GAP // NODE.itemsize) + 1
        first, last = at[np.r_[0, cut]], at[np.r_[cut - 1, len(at) - 1]]
        size = NODE.itemsize
        raw = self.reader.read_ranges(self.path, [(self.header.index_at + size * int(a), size * int(z - a + 1)) for a, z in zip(first, last, strict=True)])
        run = np.searchsorted(first, at, "right") - 1
        base = np.r_[0, np.cumsum(last - first + 1)][:-1]
        return np.frombuffer(b"".join(raw), NODE)[base[run] + at - first[run]]

    def down(self, at: np.ndarray, level: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """From nodes of a level to those of a lower one that meet the box by all nodes above, and what is read of them
        if that is the leaves' level."""
        lv = levels(self.header.count, self.header.node_size, self.header.single_root)
        while True:
            leaves = level == to and to == 0
            if level == to and not leaves:
                return at, np.zeros(0, NODE)
            n = self.nodes(at)
            if leaves:
                return at, n
            if self.box is not None:
                n = n[self.meet(n)]
            lo, hi = lv[level - 1]
            # an inner node's children begin at node number `offset`
            at = (n["offset"].astype(np.int64)[:, None] + np.arange(self.header.node_size)).ravel()
            at, level = np.sort(at[(at >= lo) & (at < hi)]), level - 1

    def meet(self, n: np.ndarray) -> np.ndarray:
        b = self.box
        return np.ones(len(n), bool) if b is None else (n["minx"] <= b[2]) & (n["maxx"] >= b[0]) & (n["miny"] <= b[3]) & (n["maxy"] >= b[1])


def rings_of(geom: Table, kind: int, depth: int = 0) -> tuple[int, list[tuple[bool, np.ndarray]]]:
    """Type and rings of a geometry. Exterior rings: the first of each part of a multi-polygon that is
    stored in parts, else ring 0 only."""
    kind = geom.scalar(6, "B", kind)
    xy = geom.vector(1, "<f8")
    if xy is not None and len(xy):
        pts = xy.reshape(-1, 2)
        ends = geom.vector(0, "<u4")
        parts = np.split(pts, ends[:-1].astype(int)) if ends is not None and len(ends) > 1 else [pts]
        return kind, [(i == 0, p) for i, p in enumerate(parts)]
    out: list[tuple[bool, np.ndarray]] = []
    if depth < 4:
        found = [rings_of(p, kind, depth + 1)[1] for p in geom.tables(7)]
        found = [r for r in found if r]
        several = kind == g.MULTIPOLYGON and len(found) > 1
        for i, r in enumerate(found):
            out += [(k == 0 and (several or i == 0), p) for k, (_, p) in enumerate(r)]
    return kind, out


def properties(raw: bytes, columns: list[tuple[str, str]]) -> list:
    out: list = [None] * len(columns)
    at = 0
    while at + 2 <= len(raw):
        k = struct.unpack_from("<H", raw, at)[0]
        at += 2
        if k >= len(columns):
            break
        t = columns[k][1]
        if t in FORMATS:
            size = struct.calcsize("<" + FORMATS[t])
            if at + size > len(raw):
                raise ValueError("a property ends early")
            out[k] = struct.unpack_from("<" + FORMATS[t], raw, at)[0]
        else:
            if at + 4 > len(raw):
                raise ValueError("a property ends early")
            size = struct.unpack_from("<I", raw, at)[0]
            at += 4
            if at + size > len(raw):
                raise ValueError("a property ends early")
            v = raw[at : at + size]
            out[k] = v if t == "binary" else v.decode()
        at += size
    return out


def rings_array(features: tuple[list[tuple[bool, np.ndarray]], ...]) -> pa.Array:
    """Rings of many features as one nested column."""
    parts = [r for rings in features for r in rings]
    xy = np.concatenate([np.zeros((0, 2)), *(p for _, p in parts)])
    pts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, 0])), pa.array(np.ascontiguousarray(xy[:, 1]))], ["x", "y"])
    ends = np.r_[0, np.cumsum([len(p) for _, p in parts])].astype(np.int32)
    rings = pa.StructArray.from_arrays([pa.array([e for e, _ in parts], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pts)], ["ext", "pts"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(f) for f in features])].astype(np.int32)), rings)


@dataclass
class Part(InputPartition):
    """Features below some nodes of a level (first and last number), or (level -1) all of a file without an index, or
    (None) none."""

    level: int | None
    first: int = 0
    last: int = 0


#: Features below the nodes of a partition; bytes that are read of a feature whose end isn't known, and at once.
PART_FEATURES, GUESS, AT_ONCE = 16_384, 1024, 1 << 24


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.path = options["path"]
        self.strict = options.get("strict_index", "false").lower() == "true"
        self.failfast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.single_root = options.get("single_root", "true").lower() == "true"
        self.per_part = int(options.get("partition_features", PART_FEATURES))
        self.limit = int(options.get("max_features", 0))
        self.layout = options.get("layout", "false").lower() == "true"
        self.options = options
        self.header = Header(**json.loads(options["header"])) if "header" in options else read_header(self.path, self.single_root, options)
        self.box = [-np.inf, -np.inf, np.inf, np.inf]
        self.schema = schema

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the box columns narrow the walk; all filters are still applied by Spark."""
        for f in filters:
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 and isinstance(f.value, int | float):
                name, v = f.attribute[0], float(f.value)
                if not isinstance(f, LessThan | LessThanOrEqual) and name in ("maxx", "maxy"):
                    k = 0 if name == "maxx" else 1
                    self.box[k] = max(self.box[k], v)
                if not isinstance(f, GreaterThan | GreaterThanOrEqual) and name in ("minx", "miny"):
                    k = 2 if name == "minx" else 3
                    self.box[k] = min(self.box[k], v)
            yield f

    def walk(self, r: RangeReader) -> Walk:
        return Walk(r, self.path, self.header, None if np.isinf(self.box).all() else tuple(self.box))

    def partitions(self) -> list[Part]:
        h, r = self.header, reader_for(self.path, self.options)
        if not h.node_size or not h.count:
            return [Part(None if self.strict or not h.count and h.node_size else -1)]
        lv = levels(h.count, h.node_size, h.single_root)
        level = 0  # that of nodes with at most per_part features
        while level < len(lv) - 1 and h.node_size ** (level + 1) <= self.per_part:
            level += 1
        walk = self.walk(r)
        at = np.arange(*lv[level]) if walk.box is None else walk.down(np.arange(*lv[-1]), len(lv) - 1, level)[0]
        r.close()
        if not len(at):
            return [Part(None)]
        if self.limit:  # the first ones in order: one task stops when it has them
            return [Part(level, int(at[0]), int(at[-1]))]
        # neighbours of at most per_part features are one partition
        most = max(1, self.per_part // h.node_size**level)
        fresh = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (at[1:] // most != at[:-1] // most)])
        return [Part(level, int(at[i]), int(at[j - 1])) for i, j in zip(fresh, [*fresh[1:], len(at)], strict=True)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.level is None:
            return
        r = reader_for(self.path, self.options)
        rows: list[tuple] = []
        left = self.limit or -1
        found = self.scanned(r) if part.level < 0 else self.indexed(r, part)
        for fid, raw, at, box in found:
            if not left:
                break
            row = self.feature(raw, fid, at, box)
            if row is not None:
                rows.append(row)
                left -= 1
            if len(rows) >= 4096:
                yield self.batch(rows)
                rows = []
        if rows:
            yield self.batch(rows)
        r.close()

    def scanned(self, r: RangeReader, step: int = AT_ONCE) -> Iterator[tuple]:
        """All features of a file without an index, by steps of bytes."""
        raw, at, pos, fid = b"", 0, self.header.features_at, 0
        while True:
            size = struct.unpack_from("<I", raw, at)[0] if at + 4 <= len(raw) else -1
            if size < 0 or at + 4 + size > len(raw):
                begin = pos + len(raw)
                more = r.read(self.path, begin, max(step, size + 4))
                if not more:
                    return
                pos, raw, at = pos + at, raw[at:] + more, 0
                continue
            if not size:
                return
            yield fid, raw[at + 4 : at + 4 + size], pos + at, None
            at, fid = at + 4 + size, fid + 1

    def indexed(self, r: RangeReader, part: Part) -> Iterator[tuple]:
        """The features below a partition's nodes that meet the filter, in order."""
        h, walk = self.header, self.walk(r)
        at, leaves = walk.down(np.arange(part.first, part.last + 1), part.level, 0)
        fid = at - levels(h.count, h.node_size, h.single_root)[0][0]
        begins = leaves["offset"].astype(np.int64)
        follows = np.r_[np.diff(at) == 1, False]
        ends = np.where(follows, np.r_[begins[1:], 0], -1)
        ends[ends <= begins] = -1  # not known: the next one wasn't read
        hit = np.flatnonzero(walk.meet(leaves))
        if not len(hit):
            return
        reach = np.where(ends[hit] < 0, begins[hit] + GUESS, ends[hit])
        near = (begins[hit[1:]] >= begins[hit[:-1]]) & (begins[hit[1:]] <= reach[:-1] + GAP)
        runs = np.split(np.arange(len(hit)), np.flatnonzero(~near) + 1)
        for some in self.together([x for run in runs for x in self.bounded(run, begins[hit], reach)], begins[hit], reach):
            got = r.read_ranges(self.path, [(h.features_at + int(begins[hit[x[0]]]), int(reach[x].max() - begins[hit[x[0]]])) for x in some])
            for x, raw in zip(some, got, strict=True):
                base = int(begins[hit[x[0]]])
                for k in hit[x].tolist():
                    p = int(begins[k]) - base
                    size = struct.unpack_from("<I", raw, p)[0] if p + 4 <= len(raw) else 0
                    if size and p + 4 + size > len(raw):  # longer than guessed
                        raw += r.read(self.path, h.features_at + base + len(raw), p + 4 + size - len(raw))
                    if not size or p + 4 + size > len(raw):
                        break
                    n = leaves[k]
                    yield int(fid[k]), raw[p + 4 : p + 4 + size], h.features_at + base + p, (float(n["minx"]), float(n["miny"]), float(n["maxx"]), float(n["maxy"]))

    def bounded(self, run: np.ndarray, begins: np.ndarray, reach: np.ndarray) -> Iterator[np.ndarray]:
        """A run of near features in pieces of about AT_ONCE bytes."""
        piece = (begins[run] - begins[run[0]]) // AT_ONCE
        yield from np.split(run, np.flatnonzero(np.diff(piece)) + 1)

    def together(self, runs: list[np.ndarray], begins: np.ndarray, reach: np.ndarray) -> Iterator[list[np.ndarray]]:
        """Runs to fetch at once: of about AT_ONCE bytes in all."""
        own: list[np.ndarray] = []
        size = 0
        for run in runs:
            own.append(run)
            size += int(reach[run].max() - begins[run[0]])
            if size >= AT_ONCE:
                yield own
                own, size = [], 0
        if own:
            yield own

    def feature(self, raw: bytes, fid: int, at: int, box: Box | None) -> tuple | None:
        """A feature's row; None if it has no geometry, or is malformed."""
        try:
            t = Table.root(raw)
            p = t.place(0)
            if not p:
                return None
            kind, rings = rings_of(Table(raw, t._follow(p)), self.header.geometry_type)
            if not rings:
                return None
            if box is None:
                pts = np.concatenate([q for _, q in rings])
                box = (*np.nanmin(pts, 0).tolist(), *np.nanmax(pts, 0).tolist())
            props = t.vector(1, "u1")
            values = properties(props.tobytes() if props is not None else b"", self.header.columns)
        except (ValueError, struct.error, UnicodeDecodeError, IndexError):
            if self.failfast:
                raise
            return None
        place = (at, at + 4 + len(raw)) if self.layout else ()
        return (fid, kind, rings, *box, *place, *values)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        cols = list(zip(*rows, strict=True))
        arrays = []
        for f, c in zip(schema, cols, strict=True):
            if f.name == "rings":
                arrays.append(rings_array(c).cast(f.type))
                continue
            if pa.types.is_decimal(f.type):
                import decimal

                c = [None if v is None else decimal.Decimal(v) for v in c]
            arrays.append(pa.array(c, f.type))
        return pa.RecordBatch.from_arrays(arrays, schema=schema)


class FlatGeobuf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatgeobuf"

    def schema(self) -> str:
        return read_header(self.options["path"], self.options.get("single_root", "true").lower() == "true", dict(self.options)).spark_schema(self.options.get("layout", "false").lower() == "true")

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatGeobuf)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, strict_index: bool = False, **options) -> DataFrame:
    """A file as features. options: those of the reader of byte ranges (sources.ranges.packed_options), and
    single_root, mode, partition_features, max_features, layout. The header is read once, on the driver. A query that
    meets the file twice under different filters needs a DataFrame for each."""
    register(spark)
    h = header_of(path, options)
    packed = packed_options(path, options) | {"strict_index": str(strict_index).lower(), "header": json.dumps(asdict(h))}
    df = spark.read.format("flatgeobuf").schema(h.spark_schema(packed.get("layout") == "true")).options(**packed).load(path)
    # Spark keeps what a filter has left of a source for later queries on the same DataFrame, so each has a filter
    return df.where(F.col("maxx") >= F.lit(float("-inf")))


# ---- writing


class Builder:
    """Writes FlatBuffers front to back: a table's children follow it."""

    def __init__(self):
        self.buf = bytearray(4)

    def table(self, fields: dict[int, tuple[str, object]]) -> int:
        """fields: number -> (kind, value); kind is a struct format, or `ref` with a writer that is called
        once the table stands and returns the place of what it wrote."""
        n = max(fields, default=-1) + 1
        while len(self.buf) % 8:
            self.buf.append(0)
        vt = len(self.buf)
        self.buf += bytes(4 + 2 * n)
        while len(self.buf) % 8 != 4:
            self.buf.append(0)
        at = len(self.buf)
        self.buf += struct.pack("<i", at - vt)
        refs, places = [], {}
        for k, (kind, v) in sorted(fields.items(), key=lambda kv: -struct.calcsize("<" + ("I" if kv[1][0] == "ref" else kv[1][0]))):
            fmt = "I" if kind == "ref" else kind
            size = struct.calcsize("<" + fmt)
            while len(self.buf) % size:
                self.buf.append(0)
            places[k] = len(self.buf) - at
            if kind == "ref":
                refs.append((len(self.buf), v))
                self.buf += bytes(4)
            else:
                self.buf += struct.pack("<" + fmt, v)
        struct.pack_into("<HH", self.buf, vt, 4 + 2 * n, len(self.buf) - at)
        for k, o in places.items():
            struct.pack_into("<H", self.buf, vt + 4 + 2 * k, o)
        for place, write in refs:
            struct.pack_into("<I", self.buf, place, write() - place)
        return at

    def vector(self, values: np.ndarray | bytes, text: bool = False) -> int:
        raw = values if isinstance(values, bytes) else values.tobytes()
        item = 1 if isinstance(values, bytes) else values.itemsize
        while (len(self.buf) + 4) % max(4, item):
            self.buf.append(0)
        at = len(self.buf)
        self.buf += struct.pack("<I", len(raw) // item) + raw + (b"\0" if text else b"")
        return at

    def tables(self, writers: list) -> int:
        while len(self.buf) % 4:
            self.buf.append(0)
        at = len(self.buf)
        self.buf += struct.pack("<I", len(writers)) + bytes(4 * len(writers))
        for i, w in enumerate(writers):
            place = at + 4 + 4 * i
            struct.pack_into("<I", self.buf, place, w() - place)
        return at

    def finish(self, root: int) -> bytes:
        struct.pack_into("<I", self.buf, 0, root)
        return bytes(self.buf)


def _geometry(b: Builder, kind: int, rings: list[tuple[bool, np.ndarray]], root: bool = True) -> int:
    """Multi-polygons with several exteriors are stored in parts, all else flat."""
    starts = [i for i, (e, _) in enumerate(rings) if e]
    if kind == g.MULTIPOLYGON and len(starts) > 1:
        groups = [rings[a:z] for a, z in zip(starts, [*starts[1:], len(rings)], strict=True)]
        return b.table({6: ("B", kind), 7: ("ref", lambda: b.tables([lambda r=r: _geometry(b, g.POLYGON, r, False) for r in groups]))})
    xy = np.concatenate([r for _, r in rings]).astype("<f8").ravel()
    fields: dict[int, tuple[str, object]] = {1: ("ref", lambda: b.vector(xy)), 6: ("B", kind)}
    if len(rings) > 1:
        ends = np.cumsum([len(r) for _, r in rings]).astype("<u4")
        fields[0] = ("ref", lambda: b.vector(ends))
    return b.table(fields)


def blob(kind: int, rings: list[tuple[bool, np.ndarray]], props: dict, columns: list[tuple[str, str]]) -> bytes:
    """A feature with its size before it."""
    raw = b""
    for k, (name, t) in enumerate(columns):
        v = props.get(name)
        if v is not None:
            body = struct.pack("<" + FORMATS[t], v) if t in FORMATS else None
            if body is None:
                v = v if isinstance(v, bytes) else v.encode()
                body = struct.pack("<I", len(v)) + v
            raw += struct.pack("<H", k) + body
    b = Builder()
    fields: dict[int, tuple[str, object]] = {0: ("ref", lambda: _geometry(b, kind, rings))}
    if raw:
        fields[1] = ("ref", lambda: b.vector(raw))
    body = b.finish(b.table(fields))
    return struct.pack("<I", len(body)) + body


def head_bytes(count: int, box: np.ndarray | None, columns: list[tuple[str, str]], node_size: int, geometry_type: int) -> bytes:
    b = Builder()
    fields: dict[int, tuple[str, object]] = {HEADER_TYPE: ("B", geometry_type), HEADER_COUNT: ("Q", count), HEADER_NODE: ("H", node_size)}
    if box is not None:
        fields[HEADER_ENVELOPE] = ("ref", lambda: b.vector(box.astype("<f8")))
    if columns:
        fields[HEADER_COLUMNS] = ("ref", lambda: b.tables([lambda n=n, t=t: b.table({0: ("ref", lambda: b.vector(n.encode(), True)), 1: ("B", TYPES.index(t))}) for n, t in columns]))
    head = b.finish(b.table(fields))
    return MAGIC + b"\x00" + struct.pack("<I", len(head)) + head


def hilbert(x: np.ndarray, y: np.ndarray, bits: int = 16) -> np.ndarray:
    """The place of points of a square grid on the Hilbert curve."""
    x, y, d = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for k in range(bits - 1, -1, -1):
        right, up = x >> k & 1, y >> k & 1
        d += (3 * right ^ up) << 2 * k
        turn = up == 0
        flip = turn & (right == 1)
        x, y = np.where(flip, (1 << bits) - 1 - x, x), np.where(flip, (1 << bits) - 1 - y, y)
        x, y = np.where(turn, y, x), np.where(turn, x, y)
    return d


def at_places(path: str, rows: Iterator[tuple[int, bytes]]) -> int:
    """Writes bytes at their places of a file that is there; what is written twice is the same."""
    n, fd = 0, os.open(path, os.O_WRONLY)
    try:
        for at, raw in rows:
            os.pwrite(fd, raw, at)
            n += 1
    finally:
        os.close(fd)
    return n


def write_frame(features: DataFrame, path: str, columns: list[tuple[str, str]], node_size: int = 16, geometry_type: int = 0, partitions: int | None = None) -> None:
    """Writes features (geom_type, rings, their box if known, and properties: name and type of columns) to one file on a
    file system that all executors share. Tasks encode features; these are dealt and sorted along the Hilbert curve
    through the middles of their boxes. A row for each partition tells the driver how many features and bytes it has, so
    that the places of all bytes are known; tasks then write features and index nodes there, each level of the index
    being aggregated from the one below. A lost task writes the same bytes again. Features without a vertex are left
    out."""
    from tilespark.operators.features import BOX, with_box
    from tilespark.sources.shared import stored

    spark = features.sparkSession
    f = with_box(features).where("minx <= maxx and miny <= maxy").select("geom_type", "rings", *BOX, *(n for n, _ in columns))
    whole = f.agg(*((F.min if c.startswith("min") else F.max)(c) for c in BOX)).first()
    box = None if whole[0] is None else np.array(whole, float)

    def encode(batches):
        for b in batches:
            bx = np.stack([b.column(c).to_numpy() for c in BOX], 1)
            wide = np.maximum(box[2:] - box[:2], 1e-300)
            cell = np.clip(((bx[:, :2] + bx[:, 2:]) / 2 - box[:2]) / wide * 65535, 0, 65535)
            blobs = []
            for r in b.select(["geom_type", "rings", *(n for n, _ in columns)]).to_pylist():
                rings = [(q["ext"], np.array([(p["x"], p["y"]) for p in q["pts"]], float).reshape(-1, 2)) for q in r["rings"]]
                blobs.append(blob(r["geom_type"], rings, r, columns))
            yield pa.RecordBatch.from_arrays([pa.array(hilbert(cell[:, 0], cell[:, 1])), *(b.column(c) for c in BOX), pa.array(blobs, pa.binary())], names=["h", *BOX, "raw"])

    boxes = ", ".join(f"{c} double" for c in BOX)
    made = stored(f.mapInArrow(encode, f"h long, {boxes}, raw binary"), "features")

    def number(batches):
        from pyspark import TaskContext

        n = at = 0
        for b in batches:
            size = np.diff(np.frombuffer(b.column("raw").cast(pa.large_binary()).buffers()[1], np.int64)[b.column("raw").offset :][: b.num_rows + 1]) if b.num_rows else np.zeros(0, np.int64)
            ends = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, TaskContext.get().partitionId(), np.int32)), pa.array(n + np.arange(b.num_rows)), pa.array(ends - size), pa.array(size), *(b.column(c) for c in (*BOX, "raw"))], names=["part", "n", "at", "size", *BOX, "raw"])
            n, at = n + b.num_rows, at + int(size.sum())

    order = ["h", *BOX, "raw"]
    dealt = made.repartitionByRange(partitions or spark.sparkContext.defaultParallelism, *order[:5]).sortWithinPartitions(*order)
    rows = stored(dealt.mapInArrow(number, f"part int, n long, at long, size long, {boxes}, raw binary"), "sorted-features")
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("part").collect()
    count, total = sum(p["n"] for p in parts), sum(p["size"] for p in parts)
    head = head_bytes(count, box, columns, node_size, geometry_type)
    lv = levels(count, node_size) if node_size and count else []
    index_at, features_at = len(head), len(head) + (NODE.itemsize * lv[0][1] if lv else 0)
    with open(path, "wb") as out:
        out.write(head)
        out.truncate(features_at + total)
    bases, n, at = [], 0, 0
    for p in parts:
        bases.append((p["part"], n, at))
        n, at = n + p["n"], at + p["size"]
    if not count:
        return
    base = spark.createDataFrame(bases, "part int, first long, begin long")  # a row for each partition
    rows = rows.join(F.broadcast(base), "part").select((F.col("n") + F.col("first")).alias("n"), (F.col("at") + F.col("begin")).alias("at"), *BOX, "raw")

    def put(batches):
        for b in batches:
            done = at_places(path, ((features_at + a, r.as_buffer()) for a, r in zip(b.column("at").to_pylist(), b.column("raw"), strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["done"])

    def put_nodes(first: int):
        def run(batches):
            for b in batches:
                nodes = np.zeros(b.num_rows, NODE)
                for c in NODE.names:
                    nodes[c] = b.column(c).to_numpy()
                where = (index_at + NODE.itemsize * (first + b.column("n").to_numpy())).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([at_places(path, zip(where, (x.tobytes() for x in nodes), strict=True))], pa.int64())], names=["done"])

        return run

    def finished(df: DataFrame, what, want: int) -> None:
        got = df.mapInArrow(what, "done long").agg(F.sum("done")).first()[0]
        if got != want:
            raise OSError(f"{path}: {got} of {want} pieces were written")

    finished(rows.select("at", "raw"), put, count)
    level = rows.select("n", *BOX, F.col("at").alias("offset"))
    for k, (lo, hi) in enumerate(lv):
        if k:  # nodes over the level below; `offset` is the number of the first child
            up = level.groupBy(F.floor(F.col("n") / node_size).cast("long").alias("n")).agg(*((F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOX))
            level = stored(up.withColumn("offset", F.col("n") * node_size + lv[k - 1][0]), "index-level")
        finished(level.select("n", *NODE.names), put_nodes(lo), hi - lo)


def write(path: str, features: Iterable[tuple[int, list[tuple[bool, np.ndarray]], dict]], columns: list[tuple[str, str]], node_size: int = 16, geometry_type: int = 0, single_root: bool = True) -> None:
    """Writes a file: features are (type, rings, properties by name), columns (name, type). For files of one
    writer; features keep their order, the index is packed in that order."""
    blobs, boxes = [], []
    for kind, rings, props in features:
        blobs.append(blob(kind, rings, props, columns))
        pts = np.concatenate([r for _, r in rings])
        boxes.append((*pts.min(0), *pts.max(0)))
    box = np.array(boxes, float).reshape(-1, 4)
    out = [head_bytes(len(blobs), np.r_[box[:, :2].min(0), box[:, 2:].max(0)] if len(box) else None, columns, node_size, geometry_type)]
    if node_size and blobs:
        lv = levels(len(blobs), node_size, single_root)
        nodes = np.zeros(lv[0][1], NODE)
        lo, hi = lv[0]
        for i, c in enumerate(("minx", "miny", "maxx", "maxy")):
            nodes[c][lo:hi] = box[:, i]
        sizes = np.array([len(x) for x in blobs])
        nodes["offset"][lo:hi] = np.cumsum(sizes) - sizes
        for (clo, chi), (plo, phi) in zip(lv, lv[1:], strict=False):
            first = clo + np.arange(phi - plo) * node_size
            nodes["offset"][plo:phi] = first
            for c, f in (("minx", np.minimum), ("miny", np.minimum), ("maxx", np.maximum), ("maxy", np.maximum)):
                nodes[c][plo:phi] = f.reduceat(nodes[c][clo:chi], first - clo)
        out.append(nodes.tobytes())
    with open(path, "wb") as f:
        f.write(b"".join(out + blobs))
