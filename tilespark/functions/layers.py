"""Layers and tiles as bytes, from encoded features in the order of their tiles: whole Arrow batches at once.

A feature's geometry and the texts of its properties arrive ready-made; what is left is numbering keys and
values by first appearance in each layer, and putting bytes in a row. A layer may go on in the next batch:
its dictionaries are kept, its features are bytes already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tilespark.functions import pbf

I = np.int64  # noqa: E741


def numbered(group: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers items from 0 by their first appearance in their group (groups ascend): the number of each, and
    group and item of all that were numbered, in the order of their numbers."""
    if not len(item):
        z = np.zeros(0, I)
        return z, z, z
    _, first, of = np.unique(group * (int(item.max()) + 1) + item, return_index=True, return_inverse=True)
    order = np.argsort(first)
    at = first[order]
    groups = group[at]
    rank = np.empty(len(order), I)
    rank[order] = np.arange(len(order)) - np.searchsorted(groups, groups)
    return rank[of], groups, item[at]


def in_a_row(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """pieces: (bytes of all rows, size by row). Each row's pieces one after another, and the rows' sizes."""
    sizes = np.sum([s for _, s in pieces], axis=0, dtype=I)
    begin = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for flat, size in pieces:
        if not len(flat):
            continue
        if len(size) == len(flat) and (size == 1).all():
            out[begin] = flat
        else:
            own = np.cumsum(size) - size
            out[np.repeat(begin - own, size) + np.arange(len(flat))] = flat
        begin = begin + size
    return out, sizes


def flag(byte: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One byte in the rows of a mask."""
    return np.full(int(where.sum()), byte, np.uint8), where.astype(I)


def number_piece(v: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Varints of v in the rows of a mask."""
    flat, got = pbf.varints(v[where])
    size = np.zeros(len(v), I)
    size[where] = got
    return flat, size


def feature_fields(kind: np.ndarray, ids: np.ndarray, has_id: np.ndarray, tags: tuple[np.ndarray, np.ndarray], geometry: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Layer fields of features (id, tags, type, geometry, in this order): bytes of all, size of each."""
    every = np.ones(len(kind), bool)
    length = np.sum([s for _, s in geometry], axis=0, dtype=I)
    head = np.empty((len(kind), 2), np.uint8)
    head[:, 0], head[:, 1] = 0x18, kind
    body = [
        flag(0x08, has_id), number_piece(ids, has_id),
        flag(0x12, tags[1] > 0), number_piece(tags[1], tags[1] > 0), tags,
        (head.ravel(), np.full(len(kind), 2, I)),
        flag(0x22, length > 0), number_piece(length, length > 0), *geometry,
    ]
    size = np.sum([s for _, s in body], axis=0, dtype=I)
    return in_a_row([flag(0x12, every), number_piece(size, every), *body])


def value_message(text: str) -> bytes:
    """The value message of a property's text: its kind's first letter, then the value."""
    t, v = text[0], text[1:]
    if t == "s":
        return pbf.value("string", v)
    if t == "d":
        return pbf.value("double", float(v))
    return pbf.value("bool", v == "1") if t == "b" else pbf.value("uint" if t == "u" else "int", int(v))


def list_offsets(a: pa.Array) -> np.ndarray:
    o = np.asarray(a.offsets).astype(I)
    return o - o[0]


def byte_pieces(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column without nulls, and sizes."""
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(0, I)
    a = a.cast(pa.large_binary())
    offs = np.frombuffer(a.buffers()[1], I)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], np.diff(offs)


def command_pieces(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Varints of a list column without nulls, and their bytes by row."""
    flat, size = pbf.varints(a.flatten().to_numpy(zero_copy_only=False))
    return flat, np.diff(np.r_[0, np.cumsum(size)][list_offsets(a)])


#: Tiles in pieces: layer fields in a row. Those of a tile, in the order of ord, section (0 keys, 1 values, 2 features), run
#: and part, are its layers without their heads; first: the number of a piece's first key or value; n: how many fields
#: it has. A row of ord -1 only says that the tile is there.
PIECES = "z int, x bigint, y bigint, ord int, section int, run int, part int, first bigint, n int, bytes binary"
#: Keys or values in a piece.
ITEMS = 10_000


def layer_head(name: str, extent: int) -> bytes:
    """What a layer begins with: version, name and extent."""
    return b"\x78\x02" + pbf.field(1, name.encode()) + pbf.number(5, extent)


class OpenLayer:
    """A layer whose features are still coming. keys: numbers of its source's keys; values: layer fields; parts: how
    many pieces of features it has."""

    def __init__(self, ord_: int):
        self.ord, self.keys, self.values, self.parts = ord_, {}, {}, 0

    def number(self, kind: str, new: list) -> np.ndarray:
        known = getattr(self, kind)
        return np.array([known.setdefault(x, len(known)) for x in new], I)


class Pieces:
    """Pieces of tiles from batches with columns z, x, y, ord, kind, cmds, geom, vals, id, sorted by tile, ord and feature.
    layers: (name, extent, keys) by ord. A row of ord -1 only says that the tile is wanted. vals holds a text for each key
    of the layer, or null. Of a layer's features no more than a batch is held, and its dictionaries."""

    def __init__(self, layers: list[tuple[str, int, list[str]]]):
        self.keys = [[pbf.field(3, k.encode()) for k in names] for _, _, names in layers]
        self.tile: tuple[int, int, int] | None = None
        self.open: OpenLayer | None = None

    def close_layer(self) -> Iterator[tuple]:
        if self.open is not None:
            o = self.open
            for section, items in ((0, [self.keys[o.ord][k] for k in o.keys]), (1, list(o.values))):
                for part, first in enumerate(range(0, len(items), ITEMS)):
                    some = items[first : first + ITEMS]
                    yield (*self.tile, o.ord, section, 0, part, first, len(some), b"".join(some))
            self.open = None

    def feed(self, b: pa.RecordBatch) -> Iterator[tuple]:
        if not b.num_rows:
            return
        z, x, y, ord_ = (b.column(c).to_numpy(zero_copy_only=False).astype(I) for c in ("z", "x", "y", "ord"))
        fresh = np.r_[True, (z[1:] != z[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (ord_[1:] != ord_[:-1])]
        begin = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        tiles = list(zip(z[begin].tolist(), x[begin].tolist(), y[begin].tolist(), strict=True))
        ords = ord_[begin].tolist()
        on = tiles[0] == self.tile and self.open is not None and self.open.ord == ords[0]

        vals = b.column("vals")
        per, flat = list_offsets(vals), vals.flatten()
        row = np.repeat(np.arange(b.num_rows), np.diff(per))
        there = flat.is_valid().to_numpy(zero_copy_only=False)
        coded = flat.filter(pa.array(there)).dictionary_encode()
        messages = [pbf.field(4, value_message(t)) for t in coded.dictionary.to_pylist()]
        key, row = (np.arange(len(flat)) - per[row])[there], row[there]
        value = coded.indices.to_numpy(zero_copy_only=False).astype(I)
        key_no, key_run, key_new = numbered(run[row], key)
        value_no, value_run, value_new = numbered(run[row], value)
        key_at, value_at = (np.searchsorted(r, np.arange(len(ords) + 1)) for r in (key_run, value_run))
        if on:  # the first run goes on: its numbers are those of the open layer
            n = int(np.searchsorted(run[row], 1))
            key_no[:n] = self.open.number("keys", key_new[: key_at[1]].tolist())[key_no[:n]] if n else key_no[:n]
            value_no[:n] = self.open.number("values", [messages[v] for v in value_new[: value_at[1]].tolist()])[value_no[:n]] if n else value_no[:n]
        tag_bytes, tag_size = pbf.varints(np.stack([key_no, value_no], 1).ravel())
        tag_size = np.bincount(np.repeat(row, 2), tag_size, b.num_rows).astype(I)

        ids = b.column("id")
        has_id = ids.is_valid().to_numpy(zero_copy_only=False) & (ord_ >= 0)
        kinds = pc.fill_null(b.column("kind"), 0).to_numpy(zero_copy_only=False)
        geometry = [command_pieces(b.column("cmds")), byte_pieces(b.column("geom"))]
        made, size = feature_fields(kinds, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), has_id, (tag_bytes, tag_size), geometry)
        ends = np.r_[0, np.cumsum(size)][np.r_[begin, b.num_rows]].tolist()
        counts = np.diff(np.r_[begin, b.num_rows]).tolist()

        key_list, value_list = key_new.tolist(), value_new.tolist()
        for k, (tile, o) in enumerate(zip(tiles, ords, strict=True)):
            if not (k == 0 and on):
                yield from self.close_layer()
            self.tile = tile
            if o < 0:
                yield (*tile, -1, 0, 0, 0, 0, 0, b"")
                continue
            if not (k == 0 and on):
                self.open = OpenLayer(o)
                self.open.keys = {v: i for i, v in enumerate(key_list[key_at[k] : key_at[k + 1]])}
                self.open.values = {messages[v]: i for i, v in enumerate(value_list[value_at[k] : value_at[k + 1]])}
            yield (*tile, o, 2, 0, self.open.parts, 0, counts[k], made[ends[k] : ends[k + 1]].tobytes())
            self.open.parts += 1

    def finish(self) -> Iterator[tuple]:
        yield from self.close_layer()


class Assembler:
    """The same batches to whole tiles, (z, x, y, bytes); each tile has all layers, empty ones included."""

    def __init__(self, layers: list[tuple[str, int, list[str]]]):
        self.pieces = Pieces(layers)
        self.heads = [layer_head(name, extent) for name, extent, _ in layers]
        self.tile: tuple[int, int, int] | None = None
        self.held: list[list[list[bytes]]] = []

    def close_tile(self) -> Iterator[tuple[int, int, int, bytes]]:
        if self.tile is not None:
            layers = [pbf.field(3, b"".join([head, *keys, *values, *features])) for head, (keys, values, features) in zip(self.heads, self.held, strict=True)]
            yield (*self.tile, b"".join(layers))
        self.tile = None

    def take(self, pieces: Iterator[tuple]) -> Iterator[tuple[int, int, int, bytes]]:
        for z, x, y, ord_, section, *_, raw in pieces:
            if (z, x, y) != self.tile:
                yield from self.close_tile()
                self.tile, self.held = (z, x, y), [[[], [], []] for _ in self.heads]
            if ord_ >= 0:
                self.held[ord_][section].append(raw)

    def feed(self, b: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        yield from self.take(self.pieces.feed(b))

    def finish(self) -> Iterator[tuple[int, int, int, bytes]]:
        yield from self.take(self.pieces.finish())
        yield from self.close_tile()
