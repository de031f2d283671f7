"""The prefix trie of conversations, as a Cartesian tree over the LCP array of the sorted conversations.

Conversations are rows of turn digests (16 bytes a turn; texts go no further), sorted by range partitioning, so the
members of a trie node are an interval of positions. LCP[i] is how many turns conversations i - 1 and i share.
A node with two or more children, or with ends beside children, is the interval between the nearest smaller
values around some LCP[i]; equal values within it are one node. Blocks (partitions of the order) find nearest
smaller values by a stack, all by themselves. What stays open at their edges are two monotone chains, at most a row for
each depth: the block beyond in which the smaller value lies comes from the blocks' minima (a row a block), the place
within it from that block's chain. Depths between a node and its parent, and those of a single conversation
beyond both its neighbours, are expanded from the interval. Counts, leaves and saved tokens are differences of
prefix sums at an interval's ends, the smallest member comes from stacks and block minima, and members that end at a
node stand at its beginning; lists of such ends that cross blocks are hashed as a stream of pieces.

Rebuilding: conversation c takes the first h turns of the group's first conversation c - c % group, then its own
turns after its first h, h being the checksum of c modulo `most`.

Null roles and texts are empty, null turns come first, rows with equal turn are ordered by their digest, repeated
rows are turns of their own. Rows without conv_id belong to no conversation. Conversations may be turnless; those with
equal turns are members of the same nodes. An empty table has no nodes, not even a root. A conversation's digests
and weights (24 bytes a turn) must fit a task; texts may be of any length. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import BROADCAST_ROWS, stored

#: A block holds about so many turns and conversations.
BLOCK = 400_000
#: Ids in one piece of a list of ends.
PIECE = 50_000
EMPTY = hashlib.sha256(b"").hexdigest()
NONE = np.iinfo(np.int64).max

LOCAL = "kind int, block int, oid long, l long, r long, lo int, v int, k long, e long, conv long, parent long, parent_oid long, leaves long, saved long, weights array<long>, ends string, left_open boolean, right_open boolean, l_value int, r_value int, up_l long, up_r long, a_l long, a_r long, s_l long, s_r long, last long, last_len int, tail_min long, tail_leaves long, tail_saved long, head_min long, head_leaves long, head_saved long, piece long, ids string"
NODE, OPEN, RUN, TOTAL = 0, 1, 2, 3


@dataclass(frozen=True)
class Rebuild:
    group: int = 100
    most: int = 6


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def sequences(conversations: DataFrame, how: Rebuild = Rebuild()) -> DataFrame:
    """conv_id, d (digests of turns), w (code points of their texts) of every rebuilt conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", digest(role, text).alias("d"), F.char_length(text).cast("long").alias("w")).alias("t"))
    own = stored(turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % how.most).cast("int")
    first = own.where(F.col("conv_id") % how.group == 0).select(F.col("conv_id").alias("_p"), F.slice("t", 1, how.most).alias("_f"))
    both = own.withColumn("_p", F.col("conv_id") - F.col("conv_id") % how.group).join(first, "_p", "left")
    none = F.slice("t", 1, 0)
    built = F.concat(F.coalesce(F.slice("_f", F.lit(1), h), none), F.slice("t", h + 1, F.size("t")))
    return both.select("conv_id", built.alias("t")).select("conv_id", F.col("t.d").alias("d"), F.col("t.w").alias("w"))


def shared(a: Column, b: Column) -> Column:
    """How many first digests two conversations share."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(other == 0, F.size(a)).otherwise(other - 1).cast("int")


class Minima:
    """Minima of runs of blocks: a table for each power of two."""

    def __init__(self, values: list[int]):
        self.levels = [np.array(values, np.int64)]
        while len(self.levels[-1]) > 1 << len(self.levels) - 1:
            x, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0])

    def over(self, lo: int, hi: int) -> int:
        """Of blocks lo to hi - 1."""
        if lo >= hi:
            return NONE
        k = (hi - lo).bit_length() - 1
        return int(min(self.levels[k][lo], self.levels[k][hi - (1 << k)]))

    def before(self, b: int, v: int) -> int:
        """The last block before b with a value below v, or -1."""
        for k in range(len(self.levels) - 1, -1, -1):
            while b >= 1 << k and self.levels[k][b - (1 << k)] >= v:
                b -= 1 << k
        return b - 1

    def after(self, b: int, v: int) -> int:
        """The first block after b with a value below v, or their number."""
        b += 1
        n = len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            while b + (1 << k) <= n and self.levels[k][b] >= v:
                b += 1 << k
        return b


def common_prefixes(off: np.ndarray, d: np.ndarray, first: int) -> np.ndarray:
    """LCP of each row with the one before it (first for row 0). d: two numbers a digest; off: where rows begin."""
    size = np.diff(off)
    m = np.minimum(size[1:], size[:-1])
    out = np.r_[first, m].astype(np.int64)
    row = np.repeat(np.arange(len(m)), m)
    k = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
    other = np.flatnonzero((d[off[row] + k] != d[off[row + 1] + k]).any(1))
    at, where = np.unique(row[other], return_index=True)
    out[at + 1] = k[other[where]]
    return out


class Block:
    """A block's part of the tree. lcp has a value for each row, and that of the row after the last."""

    def __init__(self, lcp: list[int], size: list[int], conv: list[int], last_block: bool):
        self.lcp, self.size, self.conv, self.n = lcp, size, conv, len(conv)
        self.v, self.left, self.right, self.first, self.last, self.k, self.e, self.low, self.parent = ([] for _ in range(9))
        self.of = [0] * self.n  # the node of each row's LCP
        self.stack: list[int] = []
        for i in range(self.n):
            self.feed(i, lcp[i])
        if last_block:
            self.pop(self.n, -1)
        for below, top in zip(self.stack[-2::-1], self.stack[:0:-1], strict=True):
            self.low[below] = min(self.low[below], self.low[top])

    def pop(self, i: int, x: int) -> int | None:
        """Ends the nodes whose value is above x; the last of them, if its parent is still to come."""
        stack, v, t = self.stack, self.v, None
        while stack and v[stack[-1]] > x:
            t = stack.pop()
            self.right[t] = i
            if stack:
                top = stack[-1]
                self.low[top] = min(self.low[top], self.low[t])
                self.parent[t] = top if v[top] >= x else None
        return t

    def feed(self, i: int, x: int) -> None:
        ended = self.pop(i, x)
        stack = self.stack
        if stack and self.v[stack[-1]] == x:
            t = stack[-1]
            self.k[t] += 1
            self.last[t] = i
        else:
            t = len(self.v)
            low = self.low[ended] if ended is not None else self.conv[i - 1] if i else NONE
            for name, value in (("v", x), ("left", self.last[stack[-1]] if stack else -1), ("right", -1), ("first", i), ("last", i), ("k", 1), ("e", 0), ("low", low), ("parent", None)):
                getattr(self, name).append(value)
            if ended is not None:
                self.parent[ended] = t
            stack.append(t)
        self.e[t] += self.size[i] == x
        self.low[t] = min(self.low[t], self.conv[i])
        self.of[i] = t

    def closed(self, t: int) -> bool:
        return self.left[t] >= 0 and self.right[t] >= 0

    def run(self, i: int) -> range:
        """Row i and those after it that equal it."""
        j = i + 1
        while j < self.n and self.lcp[j] == self.size[j] == self.size[i]:
            j += 1
        return range(i, j)

    def joined(self, rows: range) -> str:
        return ",".join(map(str, self.conv[rows.start : rows.stop]))


def local_rows(t: pa.Table, number: int, start: int, first: int, after: int, is_last: bool) -> list[dict]:
    """What a block finds by itself: nodes that are whole within it, open nodes, pieces of ends, and totals."""
    t = t.sort_by("idx")
    d, w = t.column("d").combine_chunks(), t.column("w").combine_chunks()
    off = np.asarray(d.offsets).astype(np.int64)
    flat = d.flatten()
    digests = np.frombuffer(b"".join(flat.to_pylist()), np.int64).reshape(-1, 2)
    off = off - off[0]
    weight = np.r_[0, np.cumsum(w.flatten().to_numpy(zero_copy_only=False))].astype(np.int64)
    size, conv = np.diff(off), t.column("conv_id").to_pylist()
    lcp = common_prefixes(off, digests, first)
    n = len(conv)
    till = weight[off[:-1] + np.maximum(lcp, 0)] - weight[off[:-1]]
    s = np.r_[0, np.cumsum(till)].tolist()
    a = np.r_[0, np.cumsum(np.r_[lcp[1:], after] < size)].tolist()
    b = Block([*lcp.tolist(), after], size.tolist(), conv, is_last)
    head = np.r_[NONE, np.minimum.accumulate(conv)].tolist()
    tail = np.minimum.accumulate(conv[::-1])[::-1].tolist()
    rows: list[dict] = []

    def weights(row: int, lo: int, v: int) -> list[int]:
        """Of depths lo + 1 to v: code points above each."""
        at = np.maximum(np.arange(lo, v), 0)
        return (weight[off[row] + at] - weight[off[row]]).tolist()

    def place(out: dict, parent: int | None) -> dict:
        """Adds the parent: its smallest member if it is whole here, else the open node that knows it."""
        if parent is not None and b.v[parent] >= 0:
            if b.closed(parent):
                out["parent"] = b.low[parent]
            else:
                out["parent_oid"] = start + b.first[parent]
        return out

    def ends_of(i: int, v: int) -> str:
        return hashlib.sha256(b.joined(b.run(i)).encode()).hexdigest() if b.size[i] == v else EMPTY

    for i in range(n):  # depths of single conversations
        lo = max(b.lcp[i], b.lcp[i + 1])
        if b.size[i] > lo:
            own = {"kind": NODE, "l": start + i, "r": start + i + 1, "lo": lo, "v": b.size[i], "k": 0, "e": 1, "conv": conv[i], "leaves": 1, "saved": 0, "weights": weights(i, lo, b.size[i]), "ends": ends_of(i, b.size[i])}
            if b.lcp[i] >= b.lcp[i + 1]:
                place(own, b.of[i])
            elif i + 1 < n:
                place(own, b.of[i + 1])
            else:
                own["parent_oid"] = start + n
            rows.append(own)
    for t in range(len(b.v)):
        v, le, ri = b.v[t], b.left[t], b.right[t]
        if b.closed(t):
            lo = max(b.lcp[le], b.lcp[ri])
            rows.append(place({"kind": NODE, "l": start + le, "r": start + ri, "lo": lo, "v": v, "k": b.k[t], "e": b.e[t] + (b.size[le] == v), "conv": b.low[t], "leaves": a[ri] - a[le], "saved": s[ri] - s[le + 1], "weights": weights(le, lo, v), "ends": ends_of(le, v)}, b.parent[t]))
            continue
        f, la = b.first[t], b.last[t]
        row = {"kind": OPEN, "block": number, "oid": start + f, "v": v, "k": b.k[t], "e": b.e[t], "conv": b.low[t], "left_open": le < 0, "right_open": ri < 0, "weights": weights(f, -1, v) if v >= 0 else []}
        row |= {"last": start + la, "last_len": b.size[la], "tail_min": tail[la], "tail_leaves": a[n] - a[la], "tail_saved": s[n] - s[la + 1], "head_min": head[f], "head_leaves": a[f], "head_saved": s[f]}
        if le >= 0:
            row |= {"l": start + le, "l_value": b.lcp[le], "up_l": start + b.first[b.of[le]], "a_l": a[le], "s_l": s[le + 1]} | ({"e": row["e"] + (b.size[le] == v)})
        if ri >= 0:
            row |= {"r": start + ri, "r_value": b.lcp[ri], "up_r": start + b.first[b.of[ri]] if ri < n else None, "a_r": a[ri], "s_r": s[ri]}
        rows.append(row)

    def pieces(run: range, **where) -> None:
        for at in range(run.start, run.stop, PIECE):
            rows.append({"kind": RUN, "v": b.size[run.start], "piece": start + at, "ids": b.joined(range(at, min(at + PIECE, run.stop))), **where})

    for t in b.stack:  # lists of ends of open nodes
        if b.lcp[b.last[t]] < b.size[b.last[t]]:
            pieces(b.run(b.last[t]), l=start + b.last[t])
    if b.lcp[0] == b.size[0]:
        pieces(b.run(0), oid=start)
    rows.append({"kind": TOTAL, "block": number, "lo": min(b.lcp[:n]), "conv": min(conv), "leaves": a[n], "saved": s[n]})
    return rows


def resolved(opens: DataFrame, totals: list, n_rows: int) -> DataFrame:
    """Open nodes with their interval, their members and the open node that is their parent. totals: (least LCP, smallest
    id, leaves, saved) by block."""
    lows, mins = Minima([t[0] for t in totals]), Minima([t[1] for t in totals])
    n = len(totals)
    sums = [np.r_[0, np.cumsum([t[k] for t in totals])].tolist() for k in (2, 3)]

    def search(batches):
        for b in batches:
            block, v, lo, ro = (b.column(c).to_pylist() for c in ("block", "v", "left_open", "right_open"))
            to_l = [lows.before(x, y) if o else None for x, y, o in zip(block, v, lo, strict=True)]
            to_r = [lows.after(x, y) if o else None for x, y, o in zip(block, v, ro, strict=True)]
            low = [min(mins.over(x + 1, at) if x is not None else NONE, mins.over(at + 1, y) if y is not None else NONE) for x, y, at in zip(to_l, to_r, block, strict=True)]
            of = lambda at, plus, k: [None if x is None else sums[k][x + plus] for x in at]
            cols = [pa.array(to_l, pa.int32()), pa.array(to_r, pa.int32()), *(pa.array(c, pa.int64()) for c in (low, of(to_l, 1, 0), of(to_l, 1, 1), of(to_r, 0, 0), of(to_r, 0, 1), of(block, 0, 0), of(block, 0, 1)))]
            yield pa.RecordBatch.from_arrays([b.column("oid"), *cols], names=["oid", "to_l", "to_r", "between", "al", "sl", "ar", "sr", "a0", "s0"])

    asked = opens.where("v >= 0")
    found = stored(asked.select("oid", "block", "v", "left_open", "right_open").mapInArrow(search, "oid long, to_l int, to_r int, between long, al long, sl long, ar long, sr long, a0 long, s0 long"), "trie-searches")
    keyed = asked.select("oid", "v").join(found, "oid")
    none = F.lit(None)
    tail = opens.where("right_open").select(F.lit("l").alias("side"), "block", "v", F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("asker"), F.struct(F.col("oid"), F.col("v"), F.col("last").alias("at"), F.col("last_len").alias("len"), F.col("tail_min").alias("low"), F.col("tail_leaves").alias("a"), F.col("tail_saved").alias("s")).alias("ref"))
    head = opens.where("left_open").select(F.lit("r").alias("side"), "block", "v", F.lit(1).alias("is_ref"), F.lit(None).cast("long").alias("asker"), F.struct(F.col("oid"), F.col("v"), F.col("oid").alias("at"), none.cast("int").alias("len"), F.col("head_min").alias("low"), F.col("head_leaves").alias("a"), F.col("head_saved").alias("s")).alias("ref"))
    kind = dict(tail.dtypes)["ref"]
    ask = lambda side: keyed.where(f"to_{side} is not null").select(F.lit(side).alias("side"), F.col(f"to_{side}").alias("block"), "v", F.lit(0).alias("is_ref"), F.col("oid").alias("asker"), none.cast(kind).alias("ref"))
    chain = Window.partitionBy("side", "block").orderBy("v", "is_ref")  # rows of a block's chain, and the searches that end in it
    hit = tail.unionByName(head).unionByName(ask("l")).unionByName(ask("r")).withColumn("ref", F.last("ref", True).over(chain)).where("asker is not null")
    hit = hit.groupBy(F.col("asker").alias("oid")).agg(F.max(F.when(F.col("side") == "l", F.col("ref"))).alias("ref_l"), F.max(F.when(F.col("side") == "r", F.col("ref"))).alias("ref_r"))
    o = asked.join(found, "oid").join(hit, "oid", "left")
    lo_, ro_, end = F.col("left_open"), F.col("right_open"), F.col("to_r") == n
    l_value, r_value = F.when(lo_, F.col("ref_l.v")).otherwise(F.col("l_value")), F.when(~ro_, F.col("r_value")).when(end, -1).otherwise(F.col("ref_r.v"))
    a_l = F.when(lo_, F.col("al") - F.col("ref_l.a")).otherwise(F.col("a0") + F.col("a_l"))
    s_l = F.when(lo_, F.col("sl") - F.col("ref_l.s")).otherwise(F.col("s0") + F.col("s_l"))
    a_r = F.when(ro_, F.col("ar") + F.coalesce("ref_r.a", F.lit(0))).otherwise(F.col("a0") + F.col("a_r"))
    s_r = F.when(ro_, F.col("sr") + F.coalesce("ref_r.s", F.lit(0))).otherwise(F.col("s0") + F.col("s_r"))
    up_l = F.when(lo_, F.col("ref_l.oid")).otherwise(F.col("up_l"))
    up_r = F.when(ro_, F.col("ref_r.oid")).otherwise(F.col("up_r"))
    # what is known of the interval's first member: it ends here if it has no more turns; counted once, below
    starts = F.when(lo_, (F.col("ref_l.len") == F.col("v")).cast("long"))
    return o.select(
        "oid", "v", "k", "e", "weights", F.when(lo_, F.col("ref_l.at")).otherwise(F.col("l")).alias("l"), F.when(~ro_, F.col("r")).when(end, n_rows).otherwise(F.col("ref_r.at")).alias("r"),
        F.greatest(l_value, r_value).alias("lo"), F.least("conv", "between", F.coalesce("ref_l.low", F.lit(NONE)), F.coalesce("ref_r.low", F.lit(NONE))).alias("conv"), (a_r - a_l).alias("leaves"), (s_r - s_l).alias("saved"),
        F.when(l_value >= r_value, up_l).otherwise(up_r).alias("parent_oid"), starts.alias("starts"), lo_.alias("left_open"),
    )


def hashed(pieces: DataFrame) -> DataFrame:
    """l, v, ends: SHA-256 of the pieces (l, v, piece, ids) of each node's list, as they stream by."""

    def run(batches):
        now, sha, out = None, None, []
        for b in batches:
            for key, ids in zip(zip(b.column("l").to_pylist(), b.column("v").to_pylist(), strict=True), b.column("ids").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if now is not None:
            out.append((*now, sha.hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["l", "v", "ends"])

    return pieces.select("l", "v", "piece", "ids").repartition("l", "v").sortWithinPartitions("l", "v", "piece").mapInArrow(run, "l long, v int, ends string")


def trie(conversations: DataFrame, how: Rebuild = Rebuild(), block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    spark = conversations.sparkSession
    seqs = stored(sequences(conversations, how), "sequences")
    n, turns = (int(x or 0) for x in seqs.agg(F.count("*"), F.sum(F.size("d"))).first())
    parts = max(1, min(n, max(2 * spark.sparkContext.defaultParallelism, -(-(n + turns) // block))))
    order = seqs.repartitionByRange(parts, "d", "conv_id").sortWithinPartitions("d", "conv_id")
    order = stored(order.withColumn("part", F.spark_partition_id()).withColumn("idx", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    # a row for each block comes to the driver: how many conversations, and what the first shares with the one before it
    per = order.groupBy("part").agg(F.count("*").alias("n"), F.min_by("d", "idx").alias("head"), F.max_by("d", "idx").alias("tail"))
    before = F.lag("tail").over(Window.orderBy("part"))
    blocks = per.select("part", "n", F.coalesce(shared(before, F.col("head")), F.lit(-1)).alias("lcp")).orderBy("part").collect()
    number = {r["part"]: i for i, r in enumerate(blocks)}
    starts = np.r_[0, np.cumsum([r["n"] for r in blocks])].tolist()
    edges = [*(r["lcp"] for r in blocks), -1]
    schema = pa.schema([pa.field(c.split()[0], KINDS[c.split()[1]]) for c in LOCAL.split(", ")])

    def find(t: pa.Table) -> pa.Table:
        i = number[t.column("part")[0].as_py()]
        return pa.Table.from_pylist(local_rows(t, i, starts[i], edges[i], edges[i + 1], i + 1 == len(blocks)), schema)

    rows = stored(order.groupBy("part").applyInArrow(find, LOCAL), "trie-blocks")
    totals = rows.where(F.col("kind") == TOTAL).select("block", "lo", "conv", "leaves", "saved").orderBy("block").collect()
    whole = rows.where(F.col("kind") == NODE)
    opened = stored(resolved(rows.where(F.col("kind") == OPEN), [tuple(r)[1:] for r in totals], n), "trie-open")
    runs = rows.where(F.col("kind") == RUN)
    late = runs.where("l is null").select("oid", "piece", "ids").join(opened.select("oid", "l", "v"), "oid").select("l", "v", "piece", "ids")
    merged = opened.groupBy("l", "v").agg(
        F.first("r").alias("r"), F.first("lo").alias("lo"), F.sum("k").alias("k"),
        # the first member was counted by a part that has it in its block, or else by none
        (F.sum("e") + F.when(F.bool_and("left_open"), F.max("starts")).otherwise(0)).alias("e"),
        F.first("conv").alias("conv"), F.first("leaves").alias("leaves"), F.first("saved").alias("saved"), F.first("weights").alias("weights"), F.first("parent_oid").alias("parent_oid"),
    )
    merged = merged.withColumn("weights", F.slice("weights", F.col("lo") + 2, F.col("v") - F.col("lo")))
    lists = runs.where("l is not null").select("l", "v", "piece", "ids").unionByName(late).join(opened.select("l", "v").distinct(), ["l", "v"], "left_semi")
    merged = merged.join(hashed(lists), ["l", "v"], "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY))).withColumn("parent", F.lit(None).cast("long"))
    cols = ["l", "r", "lo", "v", "k", "e", "conv", "parent", "parent_oid", "leaves", "saved", "weights", "ends"]
    known = opened.select(F.col("oid").alias("parent_oid"), F.col("conv").alias("open_parent"))
    nodes = whole.select(*cols).unionByName(merged.select(*cols)).join(F.broadcast(known) if opened.count() <= BROADCAST_ROWS else known, "parent_oid", "left").withColumn("parent", F.coalesce("parent", "open_parent"))
    each = nodes.select("*", F.posexplode("weights").alias("i", "above")).withColumn("depth", (F.col("lo") + 1 + F.col("i")).cast("long"))
    here, convs = F.col("depth") == F.col("v"), F.col("r") - F.col("l")
    return each.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("i") > 0, F.col("conv")).otherwise(F.col("parent")).alias("parent_conv_id"), convs.alias("n_convs"),
        F.when(here, F.col("k") + 1 - F.col("e")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("saved") - (convs - 1) * F.col("above")).alias("saved_tokens"), F.when(here, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def oracle(how: Rebuild = Rebuild()) -> str:
    """The same in DuckDB SQL over the view conversations: nodes are prefixes, told by lists of digests."""
    return f"""with recursive t0(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from t0 where k < 8),
crc as materialized (select i, c from t0 where k = 8),
ids as materialized (select distinct conv_id from conversations where conv_id is not null),
s(conv_id, hx, i, c) as (select conv_id, hex(encode(cast(conv_id as varchar))), 0, 4294967295 from ids
  union all select s.conv_id, s.hx, s.i + 1, xor(s.c // 256, t.c) from s join crc t on t.i = xor(s.c % 256, cast('0x' || substr(s.hx, 2 * s.i + 1, 2) as bigint)) where 2 * s.i < length(s.hx)),
h as (select conv_id, xor(c, 4294967295) % {how.most} as h from s where 2 * i = length(hx)),
t as materialized (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k from conversations where conv_id is not null),
built as (select h.conv_id, t.role, t.text, 0 as own, t.k from h join t on t.conv_id = h.conv_id - h.conv_id % {how.group} and t.k <= h.h union all select h.conv_id, t.role, t.text, 1, t.k from h join t on t.conv_id = h.conv_id and t.k > h.h),
r as materialized (select conv_id, row_number() over (partition by conv_id order by own, k) as d, sha256(length(role) || ':' || role || text) as g, length(text) as w from built),
p(conv_id, d, node, up, w) as (select conv_id, 0::bigint, '', cast(null as varchar), 0::bigint from ids union all select p.conv_id, r.d, sha256(p.node || r.g), p.node, r.w from p join r on r.conv_id = p.conv_id and r.d = p.d + 1),
n as materialized (select d, node, min(up) as up, min(conv_id) as c, count(*) as n, min(w) as w from p group by d, node),
len as (select i.conv_id, coalesce(max(r.d), 0) as len from ids i left join r using (conv_id) group by i.conv_id),
e as (select p.d, p.node, sha256(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id)) as ends from p join len on len.conv_id = p.conv_id and len.len = p.d group by p.d, p.node),
kids as materialized (select up as node, d - 1 as d, count(*) as k from n where d > 0 group by up, d),
sub(d, node, ad, anode, w, leaf) as (select n.d, n.node, n.d, n.node, (n.n - 1) * n.w, case when k.k is null then 1 else 0 end from n left join kids k on k.d = n.d and k.node = n.node
  union all select s.d, s.node, n.d - 1, n.up, s.w, s.leaf from sub s join n on n.d = s.ad and n.node = s.anode where n.d > 0),
tot as (select ad as d, anode as node, sum(w)::bigint as saved, sum(leaf)::bigint as leaves from sub group by ad, anode)
select n.c as conv_id, n.d::bigint as depth, u.c as parent_conv_id, n.n as n_convs, coalesce(k.k, 0) as n_children, t.leaves as n_leaves, t.saved as saved_tokens, coalesce(e.ends, '{EMPTY}') as ends_sha256
from n left join n u on u.d = n.d - 1 and u.node = n.up left join kids k on k.d = n.d and k.node = n.node left join e on e.d = n.d and e.node = n.node join tot t on t.d = n.d and t.node = n.node"""
