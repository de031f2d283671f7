"""Token ids in a content-addressed store.

A store is a folder with four Parquet tables:

* chunks   (digest, n_ids, payload): each unique chunk once; the payload is its ids as little-endian
           unsigned integers of `width` bytes, the digest BLAKE2b (16 bytes) of that payload;
* recipes  (doc_id, start, n_tokens, root, digests, part, row): in ascending doc_id order; start counts the
           ids of all documents before, digests lists the document's chunks, root is their Merkle root;
* manifest (part, block, docs, tokens, root): a root for every 1024 recipes, over all that they say but their
           digests, for which their own roots stand;
* top      (docs, tokens, root): one row, over the roots of all blocks.

Chunks end where a rolling hash of the last 8 ids has its low bits zero, so equal passages give equal
chunks wherever they stand; least and greatest lengths bound them. Writing emits each chunk's payload once
a task, brings equal digests together and keeps one. Reading back checks every chunk against its
digest, every recipe against its root, every block against the manifest and all blocks against the top.

Texts go through the tokenizers library: for the tokenizer file whose steps are known (KNOWN_STEPS) as unique
words, for any other as whole texts.

Null and empty texts hold the end id alone; very long ones are cut into chunks like all others. A null doc_id
comes first; rows with equal doc_id, also wholly repeated ones, each keep a recipe of their own, in the order of
their roots. An empty table gives an empty store. Other columns of docs don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.bpe import byte_letters
from tilespark.llm.common import chunked, frugal, lookup, remove, scratch, small_batches, text_buffer, worker_tables
from tilespark.llm.textvec import U, mix, powers
from tilespark.llm.units import UnitCache, no_cycle_search

WINDOW = 8
BLOCK = 1024


@dataclass
class Layout:
    least: int = 256
    bits: int = 10
    most: int = 8192
    width: int = 2
    end_id: int = 1


#: Bytes beside which a dot or comma is a piece of its own: ASCII letters, digits and white space.
BESIDE = np.zeros(256, bool)
BESIDE[[*b"abcdefghijklmnopqrstuvwxyz0123456789 \t\n\r\x0b\x0c"]] = True
#: Second bytes (after C3) of the letters of Latin-1.
LATIN = np.zeros(256, bool)
LATIN[0x80:0xC0] = True
LATIN[[0x97, 0xB7]] = False


def tangled(low: bytes) -> bool:
    """Whether a dot or comma of the text may share a piece with a neighbour: one that is neither letter,
    digit nor white space."""
    x = np.frombuffer(b"  " + low + b"  ", np.uint8)
    at = np.flatnonzero((x == 44) | (x == 46))
    before, after = x[at - 1], x[at + 1]
    fine = (BESIDE[before] | (LATIN[before] & (x[at - 2] == 0xC3))) & (BESIDE[after] | ((after == 0xC3) & LATIN[x[at + 2]]))
    return not fine.all()


#: Words of a to z and the letters of Latin-1, and what ASCII punctuation (but no apostrophe) may follow.
PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")


class LibraryEncoder:
    """The tokenizers library over unique words: for a tokenizer that lower-cases and parts texts at white
    space, ids of a text are those of its words. A dot or comma between letters, digits and white space is
    a word of its own there. New words go through the library together, parted by a mark."""

    def __init__(self, content: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_str(content)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.by_word = word_by_word(content)
        mark = self.lib.encode("\0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.special = [t["content"].encode() for t in json.loads(content).get("added_tokens", [])]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.cache = UnitCache(self.encode_units, most)

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        """Plain letters are one piece that normalising only lower-cases, and punctuation after them is
        another, so these go to the library's model at once; other words go through the whole library,
        together."""
        token, plain = self.lib.model.tokenize, PLAIN.fullmatch
        out: list[list[int] | None] = []
        for u in units:
            m = plain(u)
            if m is None:
                out.append(None)
                continue
            w, marks = m.groups()
            w = w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(self.letters)
            if not marks:
                out.append([t.id for t in token(w)])
            elif b"<" in marks and any(s in u for s in self.special):
                out.append(None)
            else:
                out.append([t.id for t in token(w)] + [t.id for t in token(marks.decode())])
        rest = [k for k, x in enumerate(out) if x is None]
        joint = [k for k in rest if b"\0" not in units[k]] if self.mark is not None else []
        ids = np.array(self.lib.encode(b" \0 ".join(units[k] for k in joint).decode(), add_special_tokens=False).ids if joint else [], np.int64)
        for k, x in zip(joint, np.split(ids, np.flatnonzero(ids == self.mark)) if joint else [], strict=True):
            x = x.tolist()
            out[k] = x[1:] if x and x[0] == self.mark else x
        for k in rest:
            if out[k] is None:
                out[k] = self.lib.encode(units[k].decode(), add_special_tokens=False).ids
        return out

    def words(self, raw: bytes) -> list[bytes]:
        if any(s in raw for s in self.special):
            return raw.split()
        low = raw.lower()
        if tangled(low):
            return low.split()
        return low.replace(b",", b" , ").replace(b".", b" . ").split()

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, one after another, and where each text's begin."""
        if not self.by_word:
            found = [e.ids for e in self.lib.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int64)
        per = [self.words(t) for t in texts]
        return self.cache.ids([u for p in per for u in p], np.fromiter(map(len, per), np.int64, len(per)))


#: Fixed value: the steps before the model of the tokenizer file that can be taken word by word.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def word_by_word(content: str) -> bool:
    """Whether a tokenizer file takes exactly the steps that this module takes apart: then a text's ids are those
    of its words. Special tokens must be words without white space that aren't looked for in normalised text."""
    spec = json.loads(content)
    steps = all(spec.get(k) == v for k, v in KNOWN_STEPS.items()) and not spec.get("truncation") and not spec.get("post_processor")
    plain = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    return steps and plain and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout")


_loaded: dict[str, LibraryEncoder] = {}


def loaded(content: str) -> LibraryEncoder:
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = LibraryEncoder(content)
    worker_tables["tokens"] = _loaded.clear
    return _loaded[key]


def cuts(ids: np.ndarray, at: np.ndarray, lay: Layout) -> list[np.ndarray]:
    """For each document (ids from at[i] to at[i + 1]) the ends of its chunks."""
    n = len(ids)
    pw, inv = powers(n + 1)
    c = np.r_[np.zeros(1, U), np.cumsum(mix(ids.astype(U) + U(1)) * pw[:-1])]
    hit = np.zeros(n + 1, bool)
    if n >= WINDOW:
        h = mix((c[WINDOW:] - c[:-WINDOW]) * inv[: n - WINDOW + 1])
        hit[WINDOW:] = (h & U((1 << lay.bits) - 1)) == 0
    marks = np.flatnonzero(hit)
    out = []
    for i in range(len(at) - 1):
        lo, hi = int(at[i]), int(at[i + 1])
        own, ends = marks[np.searchsorted(marks, lo + lay.least) : np.searchsorted(marks, hi)], []
        for m in [*own.tolist(), hi]:
            while m - lo > lay.most:
                lo += lay.most
                ends.append(lo)
            if m - lo >= lay.least or m == hi and m > lo:
                ends.append(m)
                lo = m
        out.append(np.array(ends, np.int64))
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd one out is carried up."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _zero_tables(steps: int = 40) -> list[np.ndarray]:
    """tables[k][j][b]: what 2**k zero bytes make of crc byte j with value b."""

    def times(op: list[int], v: int) -> int:
        r, i = 0, 0
        while v:
            if v & 1:
                r ^= op[i]
            v >>= 1
            i += 1
        return r

    op = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        op = [times(op, v) for v in op]
    out = []
    for _ in range(steps):
        out.append(np.array([[times(op, b << (8 * j)) for b in range(256)] for j in range(4)], np.int64))
        op = [times(op, v) for v in op]
    return out


_zeros: list[np.ndarray] = []


def crc_join(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings in a row, from their crc32s and the second's length."""
    if not _zeros:
        _zeros.extend(_zero_tables())
    k = 0
    while length:
        if length & 1:
            t = _zeros[k]
            a = int(t[0][a & 255] ^ t[1][a >> 8 & 255] ^ t[2][a >> 16 & 255] ^ t[3][a >> 24])
        length >>= 1
        k += 1
    return a ^ b


def write(docs: DataFrame, path: str, tokenizer: str, lay: Layout = Layout()) -> None:
    """Encodes every whole text of docs (doc_id, text) and writes the store."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    if max(json.loads(content)["model"]["vocab"].values(), default=0) >= 1 << 8 * lay.width:
        raise ValueError("ids are wider than the layout's width")
    shared = spark.sparkContext.broadcast(content)

    def encode(batches):
        enc, seen = loaded(shared.value), set()
        for b in batches:
            for lo, hi, data, offs in chunked(*text_buffer(b.column("text"))):
                raw = data.tobytes()
                with no_cycle_search():
                    body, at = enc.encode_batch([raw[offs[i] : offs[i + 1]] for i in range(hi - lo)])
                ids = np.insert(body, at[1:], lay.end_id).astype(f"<u{lay.width}")
                at = at + np.arange(len(at))
                flat = ids.tobytes()
                digests, payloads, sizes, recipes, roots = [], [], [], [], []
                for i, ends in enumerate(cuts(ids, at, lay)):
                    own, begin = [], int(at[i])
                    for e in ends.tolist():
                        p = flat[begin * lay.width : e * lay.width]
                        d = hashlib.blake2b(p, digest_size=16).digest()
                        own.append(d)
                        if d not in seen:
                            digests.append(d)
                            payloads.append(p)
                            sizes.append(e - begin)
                            seen.add(d)
                        begin = e
                    recipes.append(own)
                    roots.append(merkle(own))
                if len(seen) > 400_000:
                    seen.clear()
                n, m = hi - lo, len(digests)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([True] * n + [False] * m),
                        pa.concat_arrays([b.column("doc_id").slice(lo, n).cast(pa.int64()), pa.nulls(m, pa.int64())]),
                        pa.array(np.diff(at).tolist() + sizes, pa.int64()),
                        pa.array(roots + digests, pa.binary()),
                        pa.array(recipes + [None] * m, pa.list_(pa.binary())),
                        pa.array([None] * n + payloads, pa.binary()),
                    ],
                    names=["is_doc", "doc_id", "n", "digest", "digests", "payload"],
                )

    small_batches(spark)
    made = docs.select("doc_id", "text").mapInArrow(frugal(encode, "tokens"), "is_doc boolean, doc_id long, n long, digest binary, digests array<binary>, payload binary")
    made.write.option("compression", "zstd").parquet(f"{path}/incoming")
    made = spark.read.schema(made.schema).parquet(f"{path}/incoming")

    def first(batches):
        last = None
        for b in batches:
            d = b.column("digest").to_pylist()
            keep = [x != y for x, y in zip(d, [last, *d[:-1]], strict=True)]
            last = d[-1] if d else last
            yield b.filter(pa.array(keep, pa.bool_()))

    chunks = made.where("not is_doc").select("digest", F.col("n").alias("n_ids"), "payload").repartition("digest").sortWithinPartitions("digest")
    chunks.mapInArrow(frugal(first), "digest binary, n_ids long, payload binary").write.option("compression", "zstd").parquet(f"{path}/chunks")

    def place(batches):
        at = row = 0
        for b in batches:
            n = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + ends - n), pa.array(np.arange(row, row + len(n)))], names=[*b.schema.names, "local_start", "row"])
            at, row = at + int(n.sum()), row + len(n)

    ordered = made.where("is_doc").select("doc_id", F.col("n").alias("n_tokens"), F.col("digest").alias("root"), "digests")
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(place, "doc_id long, n_tokens long, root binary, digests array<binary>, part int, local_start long, row long").write.parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    # one row a partition, so a fixed number of them
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    recipes = placed.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "root", "digests", "part", "row")
    recipes.write.parquet(f"{path}/recipes")
    blocks(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    top(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")
    remove(spark, f"{path}/incoming")
    remove(spark, f"{path}/placed")


def joined_roots(*order: str):
    """One root over a group's roots in their order."""
    return F.sha2(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(*order, "root"))), lambda s: s["root"])), 256).alias("root")


def blocks(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes: at most BLOCK of them meet in a group."""
    said = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root"))
    g = recipes.select("part", "row", "n_tokens", said.alias("root")).groupBy("part", F.floor(F.col("row") / BLOCK).alias("block"))
    return g.agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"), joined_roots("row"))


def top(manifest: DataFrame) -> DataFrame:
    """One row over all blocks: BLOCK of a part's blocks at a time become one, until each part is one; parts are a
    fixed number."""
    level = manifest.select("part", "block", "docs", "tokens", "root")
    most = manifest.agg(F.max("block")).first()[0] or 0
    while most:
        level = level.withColumn("above", F.floor(F.col("block") / BLOCK)).groupBy("part", "above").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), joined_roots("block")).withColumnRenamed("above", "block")
        most //= BLOCK
    return level.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), joined_roots("part"))


def chunk_facts(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Reads every chunk back: digest, n_ids, crc (of the ids as 32-bit integers). A payload that doesn't
    have its digest raises."""

    def verify(batches):
        for b in batches:
            d, p = b.column("digest").to_pylist(), b.column("payload").to_pylist()
            for x, y in zip(d, p, strict=True):
                if hashlib.blake2b(y, digest_size=16).digest() != x:
                    raise ValueError(f"chunk {x.hex()} is damaged")
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(y) // width for y in p], pa.int64()), pa.array([zlib.crc32(np.frombuffer(y, f"<u{width}").astype("<u4").tobytes()) for y in p], pa.int64())], names=["digest", "n_ids", "crc"])

    return spark.read.parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(verify, "digest binary, n_ids long, crc long")


def verify_manifest(spark: SparkSession, path: str) -> int:
    """Blocks of recipes that differ from the manifest."""
    now, then = blocks(spark.read.parquet(f"{path}/recipes")), spark.read.parquet(f"{path}/manifest")
    return now.exceptAll(then).count() + then.exceptAll(now).count()


def read_back(spark: SparkSession, path: str, lay: Layout = Layout()) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the store's files. The crc is
    joined from those of the chunks as read; a missing chunk, a wrong length or root, a block that doesn't match
    the manifest, or blocks that don't match the top raise."""
    if bad := verify_manifest(spark, path):
        raise ValueError(f"{bad} blocks of recipes don't match the manifest")
    if top(spark.read.parquet(f"{path}/manifest")).collect() != spark.read.parquet(f"{path}/top").collect():
        raise ValueError("the manifest doesn't match its top root")
    recipes = spark.read.parquet(f"{path}/recipes")
    uses = recipes.select("start", F.posexplode("digests").alias("pos", "digest"))
    # chunks with the number of their uses; those that very many documents share don't meet in one task
    at = scratch(spark, "chunk-facts")
    found = chunk_facts(spark, path, lay.width)
    uses.groupBy("digest").agg(F.count("*").alias("uses")).join(found, "digest", "left").write.parquet(at)
    known = spark.read.parquet(at)
    facts = lookup(uses, known, ["digest"], "uses", int(known.agg(F.sum("uses")).first()[0] or 0))
    lists = facts.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_ids", "crc"))).alias("parts"))

    def combine(batches):
        for b in batches:
            crcs, counts = [], []
            for n, root, parts in zip(b.column("n_tokens").to_pylist(), b.column("root").to_pylist(), b.column("parts").to_pylist(), strict=True):
                crc = total = 0
                for q in parts:
                    if q["crc"] is None:
                        raise ValueError(f"chunk {q['digest'].hex()} is missing")
                    crc = crc_join(crc, q["crc"], 4 * q["n_ids"])
                    total += q["n_ids"]
                if total != n or merkle([q["digest"] for q in parts]) != root:
                    raise ValueError("a recipe doesn't match its root")
                crcs.append(crc)
                counts.append(len(parts))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    return recipes.select("doc_id", "start", "n_tokens", "root").join(lists, "start").mapInArrow(frugal(combine), "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def reconstruct(spark: SparkSession, path: str, lay: Layout = Layout()) -> DataFrame:
    """doc_id, start, ids (array<long>): the id streams themselves, put together from their chunks."""
    uses = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("digests").alias("pos", "digest"))
    full = uses.join(spark.read.parquet(f"{path}/chunks"), "digest")
    lists = full.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def unpack(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(q["payload"] for q in parts), f"<u{lay.width}").astype(np.int64) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return lists.mapInArrow(unpack, "doc_id long, start long, ids array<long>")
