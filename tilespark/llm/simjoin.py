"""Exact Jaccard join of documents on word n-grams, by universe partition and the pigeonhole principle.

A document is the set of its distinct word shingles. Sizes fall in bands, each starting at the square
root of 2 times the one before. Two sets that link
(Jaccard at least num / den) differ in at most H = floor((den - num)(|r| + |s|) / (den + num)) elements. In each
band all shingles are dealt by a hash to m segments, so at most H segments of the two sets differ, and a
budget of H + 1 spent on segments finds every pair:

* exact segments cost one signature and cover one difference. Where a set's own H is less than m - 1,
  both sides list their segments in one common order and index only their first H + 1: two sets that
  agree on m - H segments share one of these. The order puts segments last that hold nothing but shingles of many documents, which
  are the ones that would bring unrelated documents together;
* one-deletion segments also index the segment without each one of its elements; they cover two
  differences and stay selective when segments are small.

The allocation (how many of which) is chosen for each band by cost: signatures emitted plus what frequent
segments cost, from the share of frequent shingles in the corpus and the number of its sets: each further set
in a group costs comparisons, so larger corpora favour deletions. A set whose partners can reach into the
next band is indexed there, too.

Documents with equal word sequences (by 128 bits of SHA-256) are one class, so copies are never compared.
Among classes with a signature in common, first each meets its neighbours in the group and, in larger groups,
the one with the smallest id; once components are known, remaining pairs of different components
meet. Pairs of larger groups meet by parity sketches, which exclude no link, and links are verified on the words themselves. Groups are streamed in sorted order, never
gathered, and those of many members are dealt as runs or as pairs of blocks of bounded size, so no
task meets a whole large group.

Null and empty texts, and texts of white space, have an empty set and link with nothing. Fewer words than a
shingle has make one shingle. Set sizes count 64-bit hashes of shingles. Where ids repeat or are null each
row takes part for itself: it gets the smallest doc_id of its component (null where no id is known). An empty
table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import BROADCAST_ROWS, chunked, components, discard, frugal, lookup, small_batches, stored, text_buffer
from tilespark.llm.textvec import LOWER, Hasher, U, mix, words

#: Odd multipliers of a shingle's words.
_MUL = mix(np.arange(1, 65, dtype=U)) | U(1)
#: Sets of texts of so many words in all are kept while pairs are checked, and texts of so many bytes.
HELD_WORDS, HELD_BYTES = 200_000, 1 << 22
#: Neighbours in a signature's group that a class is compared with: at first, and in later rounds.
NEAR, REACH = 8, (24,)
#: Groups are compared in runs of about so many classes; all pairs of a group in blocks of so many.
RUN, PAIR_BLOCK = 1000, 256
#: Pairs of one class are dealt with copies of its text from so many on.
MANY_PAIRS = 1000
#: Frequent shingles are counted over runs of sets with so many shingles.
HELD_SHINGLES = 1_000_000
#: Sketches of so many bytes at most are broadcast, after adding them up.
BROADCAST_BYTES = 1 << 24
#: Sets of a batch with one signature from which on the group counts as met.
CROWD = 16
#: First groups of a class that tell in which of the groups that two classes share their pair is made.
FIRST_GROUPS = 32


@dataclass(frozen=True)
class Threshold:
    words: int = 4
    num: int = 85
    den: int = 100

    def differences(self, a, b):
        """Most elements that two linked sets of these sizes don't share."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def linked(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)


@dataclass(frozen=True)
class Band:
    """exact segments of which a set indexes its first H + 1 (if prefix) or all, then deletion segments."""

    low: int
    high: int
    exact: int
    deletions: int
    prefix: bool

    @property
    def segments(self) -> int:
        return self.exact + self.deletions


#: First sizes of the bands, in steps of the square root of 2.
EDGES = sorted({int(np.ceil(2 ** (k / 2))) for k in range(0, 126)})


def crowding(sets: int) -> float:
    """What a signature made of frequent shingles costs, in signatures: its set is compared with NEAR
    neighbours on the words, and by sketches with what else is frequent (a 500th of all sets)."""
    return 6.0 * NEAR + sets / 10_000


def allocate(low: int, high: int, t: Threshold, frequent: float, crowd: float = crowding(0)) -> Band:
    """The cheapest allocation for sets of low to high shingles. frequent: the share of frequent shingles;
    crowd: what a signature of frequent shingles costs.
    Segments as few, and so as large, as the band's greatest H allows: unrelated documents that share a
    passage agree on a segment only if all of it lies in the passage."""
    h = t.differences(high, high)
    size, m = (low + high) / 2, h + 1
    best = (m + crowd * m * frequent ** (size / m), Band(low, high, m, 0, True))
    for d in range(1, (h + 1) // 2 + 1):
        e = h + 1 - 2 * d
        c = size / (e + d)
        cost = e + d * (1 + c) + crowd * (e * frequent**c + d * (1 + c) * frequent ** max(c - 1, 0.0))
        best = min(best, (cost, Band(low, high, e, d, False)), key=lambda x: x[0])
    return best[1]


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    low = LOWER[data]
    start, end, doc = words(low, offs)
    n = len(offs) - 1
    h = Hasher(low).spans(start, end)
    count = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(count)]
    m = max(0, len(h) - k + 1)
    acc = np.full(m, k, U)
    for j in range(k):
        acc += h[j : j + m] * _MUL[j]
    acc = mix(acc)
    out = []
    for i in range(n):
        c, a = int(count[i]), int(first[i])
        if c >= k:
            out.append(np.unique(acc[a : a + c - k + 1]))
        elif c:
            out.append(mix(np.array([c], U) + (h[a : a + c] * _MUL[:c]).sum(dtype=U)))
        else:
            out.append(np.zeros(0, U))
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text 128 bits of the SHA-256 of its words in their order, as two numbers."""
    raw = data.tobytes().lower()
    made = [hashlib.sha256(b" ".join(raw[offs[i] : offs[i + 1]].split())).digest()[:16] for i in range(len(offs) - 1)]
    return np.frombuffer(b"".join(made), np.int64).reshape(-1, 2)


class Signatures:
    """Signatures of sets under the allocation of each band."""

    def __init__(self, t: Threshold, frequent: np.ndarray, share: float, crowd: float = crowding(0)):
        self.t, self.frequent, self.share, self.crowd = t, frequent, share, crowd
        self.bands: dict[int, Band] = {}
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[(frequent & U((1 << 20) - 1)).astype(np.int64)] = True

    def band(self, number: int) -> Band:
        if number not in self.bands:
            self.bands[number] = allocate(EDGES[number], EDGES[number + 1] - 1, self.t, self.share, self.crowd)
        return self.bands[number]

    def rare(self, s: np.ndarray) -> np.ndarray:
        out = np.ones(len(s), bool)
        maybe = np.flatnonzero(self.bloom[(s & U((1 << 20) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.frequent, s[maybe]), len(self.frequent) - 1)
            out[maybe] = self.frequent[at] != s[maybe]
        return out

    def of(self, s: np.ndarray) -> np.ndarray:
        n, t = len(s), self.t
        number = bisect_right(EDGES, n) - 1
        rare, out, first = self.rare(s), [], True
        while first or t.den * n >= t.num * EDGES[number]:  # its own band, and those that its partners reach
            b = self.band(number)
            m = b.segments
            seg = (mix(s ^ U((number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % U(m)).astype(np.int64)
            v = mix(s + U(77))
            sums = np.zeros(m, U)
            np.add.at(sums, seg, v)
            salt = mix(np.arange(m, dtype=U) + U((number + 1) << 32))
            full = mix(sums + salt)
            if b.prefix:
                take = t.differences(n, min(n * t.den // t.num, b.high)) + 1
                if take < m:
                    some_rare = np.zeros(m, bool)
                    some_rare[seg[rare]] = True
                    key = (full >> U(1)) | (U(1) << U(63)) * (~some_rare).astype(U)
                    full = full[np.argpartition(key, take - 1)[:take]]
                out.append(full)
            else:
                out.append(full)
                if b.deletions:
                    d = seg >= b.exact
                    out.append(mix(sums[seg[d]] - v[d] + salt[seg[d]]))
            number, first = number + 1, False
        return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


def scan(docs: DataFrame, t: Threshold) -> DataFrame:
    """One row a document (is_doc; id, n: size of its set, f1 and f2: fingerprint of its words), and counts of
    shingles that many of a run of different sets hold (id: the shingle's hash, n: how many)."""

    def rows_of(is_doc: bool, ids: pa.Array, n: list, f1: list, f2: list) -> pa.RecordBatch:
        arrays = [pa.array([is_doc] * len(n), pa.bool_()), ids, *(pa.array(v, pa.int64()) for v in (n, f1, f2))]
        return pa.RecordBatch.from_arrays(arrays, names=["is_doc", "id", "n", "f1", "f2"])

    def frequent(pool: list[np.ndarray]) -> pa.RecordBatch:
        all_of = np.sort(np.concatenate(pool))
        cut = np.flatnonzero(np.r_[True, all_of[1:] != all_of[:-1]])
        size = np.diff(np.r_[cut, len(all_of)])
        many = size >= max(3, len(pool) // 500)
        hot, size = all_of[cut[many]].view(np.int64), size[many].tolist()
        return rows_of(False, pa.array(hot), size, [0] * len(size), [0] * len(size))

    def look(batches):
        seen: set = set()
        pool: list[np.ndarray] = []
        held = 0
        for b in batches:
            n, prints = [], [np.zeros((0, 2), np.int64)]
            for _, _, data, offs in chunked(*text_buffer(b.column("text"))):
                f = fingerprints(data, offs)
                prints.append(f)
                for s, key in zip(shingle_sets(data, offs, t.words), map(bytes, f), strict=True):
                    n.append(len(s))
                    if len(s) and key not in seen:
                        seen.add(key)
                        pool.append(s)
                        held += len(s)
                        if held > HELD_SHINGLES:
                            yield frequent(pool)
                            pool, seen, held = [], set(), 0
            f = np.concatenate(prints)
            yield rows_of(True, b.column("doc_id").cast(pa.int64()), n, f[:, 0], f[:, 1])
        if pool:
            yield frequent(pool)

    return docs.select("doc_id", "text").mapInArrow(frugal(look), "is_doc boolean, id long, n long, f1 long, f2 long")


def signatures(docs: DataFrame, made: Signatures) -> DataFrame:
    """sig, salt, id, n: signatures of each set, once a task for word sequences that repeat there. Where CROWD
    sets of a batch share a signature the group is known to be met: all but the first of them get a
    salt of their own (from 1), so that a group with much of the corpus isn't dealt to one task."""
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def salted(sig: np.ndarray, ids: np.ndarray) -> np.ndarray:
        order = np.argsort(sig, kind="stable")
        x = sig[order]
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
        size = np.diff(np.r_[cut, len(x)])
        salt = np.zeros(len(sig), np.int32)
        for lo, k in zip(cut[size >= CROWD].tolist(), size[size >= CROWD].tolist(), strict=True):
            rest = order[lo + 1 : lo + k]
            salt[rest] = 1 + (mix(ids[rest].astype(U)) % U(1 << 20)).astype(np.int32)
        return salt

    def emit(batches):
        g, seen = shared.value, set()
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, _, data, offs in chunked(*text_buffer(b.column("text"))):
                sigs, who, size, times = [np.zeros(0, U)], [], [], []
                for i, (s, key) in enumerate(zip(shingle_sets(data, offs, g.t.words), map(bytes, fingerprints(data, offs)), strict=True)):
                    if not len(s) or key in seen:
                        continue
                    seen.add(key)
                    x = g.of(s)
                    sigs.append(x)
                    times.append(len(x))
                    who.append(ids[lo + i])
                    size.append(len(s))
                if len(seen) > 100_000:
                    seen.clear()
                sig, ident = np.concatenate(sigs).view(np.int64), np.repeat(np.array(who, np.int64), times)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(salted(sig, ident)), pa.array(ident), pa.array(np.repeat(np.array(size, np.int32), times))], names=["sig", "salt", "id", "n"])

    return docs.select("doc_id", "text").mapInArrow(frugal(emit), "sig long, salt int, id long, n int")


def sketches(docs: DataFrame, ids: DataFrame, t: Threshold) -> DataFrame:
    """rep, sketch of the documents with these ids (column rep): bit j of a sketch is the parity of the number
    of shingles that hash to j. Two sketches of a width differ in no more bits than the sets in
    elements, so pairs that differ in more bits than a link allows need no comparison. Widths are powers of 2: the
    exclusive or of a sketch's halves is the set's sketch of half the width."""

    def draw(batches):
        for b in batches:
            out = []
            for _, _, data, offs in chunked(*text_buffer(b.column("text"))):
                for s in shingle_sets(data, offs, t.words):
                    n = max(1, len(s))
                    width = 1 << max(8, int(8 * t.differences(n, n)).bit_length())
                    bits = np.bincount((mix(s ^ U(0x5BF03635)) & U(width - 1)).astype(np.int64), minlength=width) & 1
                    out.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["rep", "sketch"])

    known = docs.select("doc_id", "text")
    few = ids.select(F.col("rep").alias("doc_id")).distinct()
    known = known.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, "doc_id", "left_semi")
    return known.mapInArrow(frugal(draw), "rep long, sketch array<bigint>")


def allowed(pairs: DataFrame, drawn: DataFrame, t: Threshold) -> DataFrame:
    """Those of the pairs (a, b, and their sizes na, nb) that sketches (drawn: rep, sketch) allow to link, as (a, b)."""
    one, two = (drawn.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    width = F.least(F.size("sa"), F.size("sb"))

    def folded(c: str) -> Column:
        part = lambda i: F.aggregate(F.sequence(i, F.size(c) - 1, width), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(c, j)))
        return F.when(F.size(c) == width, F.col(c)).otherwise(F.transform(F.sequence(F.lit(0), width - 1), part))

    apart = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    may = apart * (t.den + t.num) <= (t.den - t.num) * (F.col("na").cast("long") + F.col("nb"))
    return pairs.join(two, "b").join(one, "a").where(may).select("a", "b")


def meet(rows: DataFrame, t: Threshold, reach: int) -> DataFrame:
    """Pairs (a, b) of classes that may link, of those that stand up to `reach` places apart in a cell. rows:
    sig, cell, side, place, rep, n, c, and sketch and first or not. Classes of one component (c) or too different in size
    aren't paired, nor those of one side (but side 2), nor those whose sketches exclude a link. With `first` (of
    `first_groups`) a pair is made in the first group that both have in these lists, and in every group if there is
    none."""
    sketched, listed = "sketch" in rows.columns, "first" in rows.columns

    def alike(col: pa.ListArray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether sketches allow a link, the wider of two folded to the width of the other."""
        offs = col.offsets.to_numpy()
        values = col.values.to_numpy(zero_copy_only=False).view(U)
        width = np.diff(offs)
        ok = np.ones(len(i), bool)

        def folded(at: np.ndarray, w: int) -> np.ndarray:
            out = values[offs[at][:, None] + np.arange(w)]
            for lo in range(w, int(width[at].max()), w):
                wide = np.flatnonzero(width[at] > lo)
                out[wide] ^= values[offs[at[wide]][:, None] + lo + np.arange(w)]
            return out

        narrow = np.minimum(width[i], width[j])
        for w in np.unique(narrow).tolist():
            of = np.flatnonzero(narrow == w)
            for lo in range(0, len(of), max(1, (1 << 17) // w)):
                k = of[lo : lo + max(1, (1 << 17) // w)]
                ok[k] = np.bitwise_count(folded(i[k], w) ^ folded(j[k], w)).sum(1) <= most[k]
        return ok

    def elsewhere(col: pa.ListArray, i: np.ndarray, j: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Whether another group is the first of those that the two classes have in their lists."""
        offs, width = col.offsets.to_numpy(), np.diff(col.offsets.to_numpy())
        lists = np.zeros((len(width), FIRST_GROUPS), np.int64)
        there = np.arange(FIRST_GROUPS) < width[:, None]
        lists[there] = col.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
        out = np.zeros(len(i), bool)
        for lo in range(0, len(i), 1 << 12):
            x, y = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
            both = ((lists[x][:, :, None] == lists[y][:, None, :]) & there[x][:, :, None] & there[y][:, None, :]).any(2)
            out[lo : lo + (1 << 12)] = both.any(1) & (lists[x, both.argmax(1)] != sig[x])
        return out

    def pair(batches):
        before = None
        for b in batches:
            old = 0 if before is None else before.num_rows
            now = pa.Table.from_batches([b])
            if old:
                now = pa.concat_tables([before, now])
            if not now.num_rows:
                continue
            now = now.combine_chunks()
            sig, cell, side, rep, n, c = (now.column(x).to_numpy().astype(np.int64) for x in ("sig", "cell", "side", "rep", "n", "c"))
            one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(1, min(reach, len(sig) - 1) + 1):
                i = np.arange(max(k, old), len(sig))
                j = i - k
                same = (sig[i] == sig[j]) & (cell[i] == cell[j])
                if not same.any():
                    break
                i, j = i[same], j[same]
                small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                ok = (c[i] != c[j]) & ((side[i] != side[j]) | (side[i] == 2)) & (large * t.num <= small * t.den)
                i, j = i[ok], j[ok]
                if listed and len(i):
                    ok = ~elsewhere(now.column("first").chunk(0), i, j, sig)
                    i, j = i[ok], j[ok]
                if sketched and len(i):
                    ok = alike(now.column("sketch").chunk(0), i, j, t.differences(n[i], n[j]))
                    i, j = i[ok], j[ok]
                one.append(rep[i])
                two.append(rep[j])
            x, y = np.concatenate(one), np.concatenate(two)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
            before = now.slice(max(0, len(sig) - reach))

    kept = [c for c in ("sig", "cell", "side", "rep", "n", "c", "sketch", "first") if c in rows.columns]
    dealt = rows.repartition("sig", "cell").sortWithinPartitions("sig", "cell", "place", "rep").select(*kept)
    return dealt.mapInArrow(frugal(pair), "a long, b long").distinct()


def first_groups(members: DataFrame) -> DataFrame:
    """members (sig, rep, k: size of the group sig) with `first`: FIRST_GROUPS groups of the class at most, smallest first,
    as those whose classes are most likely to meet there. The least of two classes' common groups is in both lists if
    any common one is, so both agree on it."""
    order = F.array_sort(F.collect_list(F.struct("k", "sig")))
    return members.join(members.groupBy("rep").agg(F.slice(order, 1, FIRST_GROUPS)["sig"].alias("first")), "rep")


def dealt_texts(rows: DataFrame, texts: DataFrame, many: DataFrame, key: str, other: str) -> DataFrame:
    """rows (pairs) with the text of `key` as t<key>. many (key, parts): classes with very many pairs; their
    text is copied, so that their pairs don't meet in one task."""
    parts = F.coalesce("parts", F.lit(1))
    salted = rows.join(F.broadcast(many), key, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("parts")
    copies = texts.select(F.col("doc_id").alias(key), F.col("text").alias(f"t{key}")).join(F.broadcast(many), key, "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return salted.join(copies, [key, "salt"]).drop("salt")


def verified(pairs: DataFrame, docs: DataFrame, t: Threshold) -> DataFrame:
    """Those of the pairs (a, b: ids) that link, decided on the words of their texts."""
    pairs = stored(pairs, "pairs")
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
    known = docs.select("doc_id", "text")
    texts = stored(known.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi"), "pair-texts")

    def sets(cache: dict, key: int, raw: bytes) -> frozenset:
        if key not in cache:
            w = raw.lower().split()
            k = t.words
            if cache.get("held", 0) + len(w) > HELD_WORDS:
                cache.clear()
            cache["held"] = cache.get("held", 0) + len(w)
            cache[key] = frozenset(zip(*(w[j:] for j in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        return cache[key]

    def runs(b: pa.RecordBatch):
        """Parts of a batch with about HELD_BYTES of text each."""
        size = np.cumsum(pc.binary_length(b.column("ta")).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(b.column("tb")).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + HELD_BYTES, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi

    def check(batches):
        one: dict = {}
        for b in (part for whole in batches for part in runs(whole)):
            keep = []
            cols = [b.column(c).to_pylist() for c in ("a", "b")] + [b.column(c).cast(pa.large_binary()).to_pylist() for c in ("ta", "tb")]
            for x, y, tx, ty in zip(*cols, strict=True):
                r, s = sets(one, x, tx), sets(one, y, ty)
                small = min(len(r), len(s))
                keep.append(bool(small) and t.linked(small, len(r), len(s)) and t.linked(len(r & s), len(r), len(s)))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    unit = max(MANY_PAIRS, pairs.count() // 100_000)  # so there are 100,000 with more pairs at most
    many = lambda key: pairs.groupBy(key).agg(F.ceil(F.count("*") / unit).cast("int").alias("parts")).where("parts > 1")
    both = dealt_texts(dealt_texts(pairs, texts, many("b"), "b", "a"), texts, many("a"), "a", "b")
    links = stored(both.select("a", "b", "ta", "tb").mapInArrow(frugal(check), "a long, b long"), "links")
    discard(pairs, ids, texts)
    return links


def distinct_classes(docs: DataFrame, t: Threshold) -> DataFrame:
    """doc_id, n_shingles, component (its smallest doc_id) of every row, for docs whose ids are unique and not
    null."""
    small_batches(docs.sparkSession)
    rows = stored(scan(docs, t), "shingle-scan")
    sets = rows.where("is_doc").select(F.col("id").alias("doc_id"), "n", "f1", "f2")
    kinds = stored(sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "set-classes")
    total, different, elements = (int(v or 0) for v in kinds.agg(F.sum("size"), F.count("*"), F.sum("n")).first())
    # shingles of a 500th of all sets at least: not more than 500 times the mean set size; they only order
    # segments, so leaving some out would cost time but no link
    often = rows.where("not is_doc").groupBy("id").agg(F.sum("n").alias("k")).where(F.col("k") >= max(8, different // 500))
    hot = often.orderBy(F.desc("k"), "id").limit(200_000).toPandas()
    frequent = np.sort(hot["id"].to_numpy(np.int64).view(U))
    made = Signatures(t, frequent, min(0.9, float(hot["k"].sum()) / max(1, elements)), crowding(different))

    by_sig = Window.partitionBy("sig", "salt").orderBy("id")
    met = signatures(docs, made).select("sig", "salt", "id", F.lag("id").over(by_sig).alias("p"), F.lead("id").over(by_sig).alias("q"))
    met = stored(met.where("p is not null or q is not null or salt > 0").select("sig", "id"), "shared-signatures")
    # ids that stand for a word sequence in a task -> its class
    seen = met.select(F.col("id").alias("doc_id")).distinct()
    rep_of = sets.join(seen, "doc_id", "left_semi")
    rep_of = stored(rep_of.join(kinds.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).select(F.col("doc_id").alias("id"), "rep", "n"), "set-reps")
    members = stored(met.join(F.broadcast(rep_of) if rep_of.count() <= BROADCAST_ROWS else rep_of, "id").select("sig", "rep", "n").distinct(), "class-signatures")
    groups = members.groupBy("sig").agg(F.min(F.struct("rep", "n")).alias("head"), F.count("*").alias("k")).where("k > 1")
    groups = stored(groups.select("sig", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n"), "k"), "signature-groups")
    n_members = int(groups.agg(F.sum("k")).first()[0] or 0)
    members = stored(lookup(members, groups, ["sig"], "k", n_members), "signature-members")
    near = lambda x, y: (F.greatest(x, y) * t.num <= F.least(x, y) * t.den)

    def place(seed: int) -> Column:
        return F.xxhash64("rep", F.lit(seed))

    def runs(rows: DataFrame, seed: int) -> DataFrame:
        """Groups as runs of about RUN classes of a seeded order. It is one order for all groups, and a run is a range
        of it, so that two classes are neighbours in all groups that they share, or nearly so."""
        bits = F.greatest(F.ceil(F.log2(F.col("k") / RUN)), F.lit(0)).cast("int")
        cell = F.when(bits > 0, F.call_function("shiftrightunsigned", "place", F.lit(64) - bits)).otherwise(F.lit(0).cast("long"))
        return rows.withColumn("place", place(seed)).withColumn("cell", cell).withColumn("side", F.lit(2))

    def block_pairs(rows: DataFrame) -> DataFrame:
        """Groups as pairs of blocks of about PAIR_BLOCK classes."""
        of = rows.withColumn("blocks", F.ceil(F.col("k") / PAIR_BLOCK)).withColumn("own", F.pmod(place(200), F.col("blocks")))
        of = of.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
        return of.withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).withColumn("side", side).withColumn("place", F.col("own"))

    # Each class meets its neighbours in its groups; groups of up to NEAR + 1 are done then. In larger ones it meets
    # their head, too, and classes that are still apart meet more neighbours, in other orders, so that a large
    # group of near copies soon is one component; all that is apart after that meets in pairs of blocks. In larger
    # groups, those who meet are compared by sketches, and on the words only where these allow a link: those who share
    # no more than a passage don't bring their texts together. Small groups are mostly of copies, which share many
    # signatures: sketches carried with each of these would outweigh the texts.
    large = stored(first_groups(members.where(F.col("k") > NEAR + 1)), "large-groups")
    drawn = stored(sketches(docs, large, t), "sketches")
    if (drawn.agg(F.sum(F.size("sketch") * 8 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        drawn = F.broadcast(drawn)
    stars = large.where("head <> rep").where(near(F.col("head_n"), F.col("n")))
    stars = allowed(stars.select(F.col("head").alias("a"), F.col("rep").alias("b"), F.col("head_n").alias("na"), F.col("n").alias("nb")).distinct(), drawn, t)
    within = meet(runs(members.where(F.col("k") <= NEAR + 1).withColumn("c", F.col("rep")), 0), t, NEAR)
    near_by = meet(runs(large.withColumn("c", F.col("rep")).join(drawn, "rep"), 0), t, NEAR)
    tried = stored(stars.union(within).union(near_by).distinct(), "tried-pairs")
    links = verified(tried, docs, t)
    comp = stored(components(links), "components-0")

    def still_open(comp: DataFrame) -> DataFrame:
        known = F.broadcast(comp) if comp.count() <= BROADCAST_ROWS else comp
        now = large.join(known, large["rep"] == known["node"], "left").select("sig", "rep", "n", "k", "first", F.coalesce("component", "rep").alias("c"))
        apart = stored(now.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("sig", "m"), "open-groups")
        return stored(lookup(now, apart, ["sig"], "m", n_members).join(drawn, "rep"), "open-sketches")

    now = still_open(comp)
    for seed, reach in enumerate(REACH, 1):
        if now.isEmpty():
            break
        fresh = stored(meet(runs(now, seed), t, reach).join(tried, ["a", "b"], "left_anti"), "tried-pairs")
        tried = tried.unionByName(fresh)
        more = verified(fresh, docs, t)
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = stored(components(links), f"components-{seed}")
            now = still_open(comp)
    final = comp
    if not now.isEmpty():
        # a block may be several times its mean size: every pair of a cell is met whatever its size
        most = int(block_pairs(now.select("sig", "rep", "k")).groupBy("sig", "cell").count().agg(F.max("count")).first()[0])
        more = verified(meet(block_pairs(now), t, most).join(tried, ["a", "b"], "left_anti"), docs, t)
        final = components(links.unionByName(more)) if not more.isEmpty() else comp
    named = kinds.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", "size", F.coalesce("component", "rep").alias("component"))
    named = stored(named, "named-classes")
    full = lookup(sets.where("n > 0"), named, ["n", "f1", "f2"], "size", total)
    empty = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component"))
    return full.select("doc_id", F.col("n").alias("n_shingles"), "component").unionByName(empty)


def numbered(docs: DataFrame) -> DataFrame | None:
    """Where ids repeat or are null: doc_id, text and all other columns with _row, a number that ascends with
    doc_id (nulls last). None where ids are unique."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return None
    ordered = docs.sort(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return stored(ordered.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")


def classes(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the component of the graph of links, named by its
    smallest doc_id."""
    rows = numbered(docs.select("doc_id", "text"))
    if rows is None:
        return distinct_classes(docs, t).withColumnRenamed("component", "component_id")
    found = stored(distinct_classes(rows.select(F.col("_row").alias("doc_id"), "text"), t), "row-classes").withColumnRenamed("doc_id", "_row")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    names = sizes.join(rows.select(F.col("_row").alias("component"), F.col("doc_id").alias("component_id")), "component")
    named = lookup(found, stored(names, "row-names"), ["component"], "size", found.count())
    return named.join(rows.select("_row", "doc_id"), "_row").select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, t: Threshold = Threshold()) -> DataFrame:
    """One row of each component stays, one with the smallest id (null ids only where no id is known). Where
    ids repeat or are null, rows are numbered in the order of their ids and take part under their numbers, so
    texts that share an id aren't taken for one another. Without words a row has no near copies, and one of
    those with its id stays."""
    aside = {"_row": "_row__in"} if "_row" in docs.columns else {}
    rows, key = numbered(docs.withColumnsRenamed(aside)), "_row"
    if rows is None:
        rows, key = docs, "doc_id"
    found = stored(distinct_classes(rows.select(F.col(key).alias("doc_id"), "text"), t), "row-classes")
    dropped = found.where("doc_id <> component").select(F.col("doc_id").alias(key))
    if key == "_row":
        bare = found.where("n_shingles = 0").select(F.col("doc_id").alias(key))
        bare = rows.select(key, "doc_id").join(bare, key, "left_semi")
        dropped = dropped.union(bare.join(bare.groupBy("doc_id").agg(F.min(key).alias("first")).withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).where(F.col(key) > F.col("first")).select(key))
    dropped = stored(dropped, "near-copies")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, key, "left_anti").select(*(F.col(f"`{aside.get(c, c)}`").alias(c) if key == "_row" else F.col(f"`{c}`") for c in docs.columns))
