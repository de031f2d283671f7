"""WARC archives: pages to response and revisit records, and back by boundary-chain verification.

Writing: records are texts of the version line, header fields and the block, which Spark's text writer puts in files
(parts end in .txt), so commits and lost executors are Spark's. Of pages with equal payloads of at least
`least` bytes the one with the largest page_id is the response, the others revisit it; payloads of revisits
aren't stored. Groups are made on digests of SHA-256, pre-aggregated; no payload meets another one.

Reading: archives are split at the magic of record beginnings, wherever a block of a file happens to begin, so a
payload that holds the magic falls apart too. Each task takes its block's candidates (pieces with a header and a
length) and emits where the record's successor begins. Within a block successors form a forest, of which
a candidate keeps its interval; what leads out of a block are a few exits, and pointer jumping over these alone,
from the beginning of each file, finds the one place where the true chain enters each block. Candidates whose
interval holds that entry are on the chain, all else is payload. Records that hold magics are put together again
from their pieces, found by their numbers. A chain that doesn't end at the end of its file, a payload that doesn't
have its digest, or a revisit without its response raises.

Null html is the empty payload; null urls have no target field, line ends in urls are percent-encoded; null page_ids
are kept as such and never stand before others. Repeated rows are records of their own, and of rows with equal id and
payload the last one by file and row is the response. Very long payloads are read whole (one record must fit a
task). An empty table gives no records; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilespark.llm.common import BROADCAST_ROWS, discard, lookup, small_batches, stored
from tilespark.llm.dedup import located

#: Fixed values of the format.
MAGIC, VERSION, EOL, GAP = "WARC/1.", "1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Any time does: pages have none.
DATE = "2000-01-01T00:00:00Z"

FIELDS = "type string, id string, refers string, digest string, sha1 string, bytes long, told_bytes long"
M = len(MAGIC)


def base32(sha1_hex: Column) -> Column:
    """The base32 form of a SHA-1 in hexadecimal: 40 bits are 8 letters."""
    four = [F.lpad(F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*four), CONV32, BASE32)


def records_of(pages: DataFrame, least: int = 0) -> DataFrame:
    """value: a record for each row of pages (page_id, url, html), without the empty lines that end it."""
    rows = located(pages.select("page_id", "url", "html")).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("html", 256)))
    groups = rows.where(F.octet_length("html") >= least).groupBy("_sha").agg(F.max(F.struct("page_id", "_at")).alias("_first"), F.count("*").alias("_n"))
    twice = stored(groups.where("_n > 1"), "warc-groups")
    n, total = twice.agg(F.count("*"), F.sum("_n")).first()
    marked = rows.join(F.broadcast(twice), "_sha", "left") if n <= BROADCAST_ROWS // 4 else lookup(rows, twice, ["_sha"], "_n", total, "left")
    name = lambda page, at: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), F.md5(at.cast("binary")), F.lit(">"))
    again = F.col("_n").isNotNull() & (F.col("_first._at") != F.col("_at"))
    size = F.octet_length("html")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size.cast("string"), F.lit(GAP))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat_ws(
        EOL, F.lit(MAGIC + VERSION), F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"), F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"), F.col("_at"))),
        F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.sha1(F.col("html").cast("binary")))),
        F.when(again, f"WARC-Profile: {PROFILE}"), F.when(again, F.concat(F.lit("WARC-Refers-To: "), name(F.col("_first.page_id"), F.col("_first._at")))),
        F.lit("Content-Type: application/http;msgtype=response"), F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(again, 0).otherwise(size)).cast("string")),
    )
    return marked.select(F.concat(head, F.lit(GAP), http, F.when(again, "").otherwise(F.col("html"))).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    records_of(pages, least).write.option("lineSep", GAP).text(path)


def field(head: Column, name: str) -> Column:
    v = F.regexp_extract(head, rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(v != "", v)


def parsed(text: Column, payloads: bool) -> list[Column]:
    """Of a piece, or of a record put together (what follows its magic): bytes, the distance from its magic to its
    successor (null if it is no record), whether it holds just one whole record, and then the record's FIELDS."""
    head = F.substring_index(text, GAP, 1)
    length = F.when(text.rlike(r"^\d\r\n[!-9;-~]+:") & (F.instr(text, GAP) > 0), F.try_to_number(F.regexp_extract(head, r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", 1), F.lit("999999999999999999")).cast("long"))
    after = F.octet_length(head) + 4
    size, step = F.octet_length(text).cast("long"), M + after + length + 4
    whole = F.coalesce((step == size + M) & F.endswith(text, F.lit(GAP)), F.lit(False))
    raw = text.cast("binary")
    body = F.substring(raw, after + 1, length.cast("int"))
    http = F.coalesce(field(head, "Content-Type").startswith("application/http"), F.lit(False)) & (F.instr(body.cast("string"), GAP) > 0)
    http_head = F.when(http, F.substring_index(body.cast("string"), GAP, 1))
    payload = F.when(whole, F.when(http, F.substring(body, F.octet_length(http_head) + 5, length.cast("int"))).otherwise(body))
    told = F.try_to_number(F.regexp_extract(http_head, r"(?i)\r\nContent-Length:[ \t]*(\d{1,18})", 1), F.lit("999999999999999999")).cast("long")
    id_ = field(head, "WARC-Record-ID")
    known = length.isNotNull()
    out = [
        size.alias("size"), step.alias("step"), whole.alias("whole"), F.when(known, field(head, "WARC-Type")).alias("type"), F.when(known, id_).alias("id"), F.when(known, field(head, "WARC-Refers-To")).alias("refers"),
        F.when(known, F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", "")).alias("digest"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"), F.when(whole, told).alias("told_bytes"),
    ]
    return [*out, payload.alias("payload")] if payloads else out


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the split begins) and value: what stands between magics, in the order of the file."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def runs(batches) -> Iterator[pa.Table]:
    """The rows of each block of a file (128 MB at most of pieces), which stand together."""
    held, now = [], None
    for b in batches:
        file, block = b.column("file").dictionary_encode().indices.to_numpy(), b.column("block").to_numpy()
        cut = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            if hi == lo:
                continue
            key = (b.column("file")[lo].as_py(), b.column("block")[lo].as_py())
            if held and key != now:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def forest(at: list[int], successor: list[int], end: int) -> tuple[list, list, list, list]:
    """Of a block's candidates, by place: where each chain leaves the block (None where it breaks), intervals
    (tin, tout) that hold those of all candidates from which it is reached, and the number of its successor (None
    outside)."""
    number = {a: i for i, a in enumerate(at)}
    n = len(at)
    parent: list = [number.get(s) for s in successor]
    leave: list = [None] * n
    size, tin, free = [1] * n, [0] * n, [0] * n
    for i in range(n):  # successors stand behind
        if parent[i] is not None:
            size[parent[i]] += size[i]
    top = 0
    for i in range(n - 1, -1, -1):
        p = parent[i]
        leave[i] = leave[p] if p is not None else successor[i] if successor[i] >= end else None
        if p is None:
            tin[i], top = top, top + size[i]
        else:
            tin[i], free[p] = free[p], free[p] + size[i]
        free[i] = tin[i] + 1
    return leave, tin, [t + s for t, s in zip(tin, size, strict=True)], parent


def candidates(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """A row for each candidate and one (without rel) for each block: rel is the place of the magic from that of the
    block's first piece, seq the piece's number, stop that of its successor's piece (or how many pieces there are)."""

    def look(batches):
        for t in runs(batches):
            size = t.column("size").to_numpy()
            rel = np.cumsum(size + M) - size - M
            total = int(rel[-1] + size[-1] + M)
            step = t.column("step")
            good = step.is_valid().to_numpy().copy()
            if t.column("block")[0].as_py() == 0:
                good[0] = False  # no magic stands before a file's first piece
            seq = np.flatnonzero(good)
            own = t.take(pa.array(seq))
            at = rel[seq].tolist()
            after = (rel[seq] + own.column("step").to_numpy()).tolist()
            leave, tin, tout, parent = forest(at, after, total)
            stop = [int(seq[p]) if p is not None else t.num_rows for p in parent]
            made = [pa.array([*at, None], pa.int64()), pa.array([*after, total], pa.int64()), pa.array([*leave, None], pa.int64()), *(pa.array([*c, None], pa.int64()) for c in (tin, tout)), pa.array([*seq.tolist(), None], pa.int64()), pa.array([*stop, t.num_rows], pa.int64())]
            plain = [pa.concat_arrays([*own.column(c).chunks, pa.nulls(1, t.schema.field(c).type)]) for c in t.column_names[4:]]
            n = len(seq) + 1
            cols = [pa.array([t.column("file")[0].as_py()] * n, pa.string()), pa.array([t.column("block")[0].as_py()] * n, pa.int64()), *made, *plain]
            yield pa.RecordBatch.from_arrays(cols, names=[*KEYS, *t.column_names[4:]])

    small_batches(spark)
    rows = pieces(spark, path).select("file", "block", *parsed(F.col("value"), payloads))
    return rows.mapInArrow(look, f"file string, block long, rel long, after long, leave long, tin long, tout long, seq long, stop long, whole boolean, {FIELDS}" + (", payload binary" if payloads else ""))


KEYS = ("file", "block", "rel", "after", "leave", "tin", "tout", "seq", "stop")


def reached(jumps: DataFrame, files: DataFrame, most_rounds: int = 64) -> DataFrame:
    """file, at: all places to which jumps (file, at, to) lead from 0, by pointer jumping: each round doubles the
    way that a jump goes. A jump stands for a block, so tables are small."""
    found = stored(files.select("file", F.lit(0).cast("long").alias("at")), "warc-reached")
    jumps, n = stored(jumps, "warc-jumps"), found.count()
    for _ in range(most_rounds):
        more = found.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        new = stored(found.union(more).distinct(), "warc-reached")
        m = new.count()
        if m == n:
            return new
        on = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        longer = stored(jumps.join(on, ["file", "to"]).select("file", "at", F.col("next").alias("to")), "warc-jumps")
        discard(found, jumps)
        found, jumps, n = new, longer, m
    raise RuntimeError("chains did not settle")


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """file, at, type, id, refers, digest, sha1 and bytes of the payload, told_bytes (of its HTTP header) of every
    record of the archives under a path, in Spark's order; payloads: with the payload itself."""
    seen = stored(candidates(spark, path, payloads), "warc-candidates")
    to_come = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = seen.where("rel is null").select("file", "block", F.col("after").alias("total"), F.col("stop").alias("n"))
    blocks = stored(blocks.withColumn("base", F.coalesce(F.sum("total").over(to_come), F.lit(0)) - M), "warc-blocks")
    small = blocks.count() <= BROADCAST_ROWS
    near = F.broadcast if small else (lambda x: x)
    placed = seen.where("rel is not null").join(near(blocks.select("file", "block", "base")), ["file", "block"])
    placed = placed.withColumns({"at": F.col("base") + F.col("rel"), "next": F.col("base") + F.col("after"), "to": F.col("base") + F.col("leave")})
    files = stored(blocks.groupBy("file").agg((F.max(F.struct("block", F.col("base") + F.col("total")))["col2"]).alias("size")), "warc-files")
    entries = stored(placed.where("to is not null").select("file", F.col("to").alias("at")).union(files.select("file", F.lit(0).cast("long"))).distinct(), "warc-entries")
    at_entries = stored(placed.select("file", "at", "to", "block", "tin", "seq").join(near(entries) if entries.count() <= BROADCAST_ROWS else entries, ["file", "at"]), "warc-entries")
    on_chain = reached(at_entries.where("to is not null").select("file", "at", "to"), files)
    ends = on_chain.groupBy("file").agg(F.max("at").alias("last")).join(files, "file").where("last <> size").select("file", "last").limit(5).collect()
    if ends:
        raise ValueError(f"chains of records break: {[tuple(r) for r in ends]}")
    entered = stored(at_entries.join(on_chain, ["file", "at"]).select("file", "block", F.col("tin").alias("entry"), F.col("seq").alias("lead")), "warc-entered")
    true = placed.join(near(entered), ["file", "block"]).where("tin <= entry and entry < tout")
    out = ["file", "at", *[c.split()[0] for c in FIELDS.split(", ")], *(["payload"] if payloads else [])]
    odd = stored(true.where("not whole").select("file", "block", "at", "seq", "stop"), "warc-odd")
    if odd.isEmpty():
        return true.select(*out)
    # numbers of the pieces of records that hold magics: in their own block, and those that stand before the entry of later ones
    last = stored(true.groupBy("file", "block").agg(F.max("at").alias("last")), "warc-last")
    own = odd.select("file", "block", F.explode(F.sequence("seq", F.col("stop") - 1)).alias("seq"), F.col("at").alias("owner"))
    led = blocks.join(entered, ["file", "block"], "left").join(last, ["file", "block"], "left")
    led = led.withColumn("owner", F.last("last", True).over(to_come)).withColumn("lead", F.coalesce("lead", "n")).where("owner is not null and lead > 0")
    led = led.join(odd.select("file", F.col("at").alias("owner")), ["file", "owner"]).select("file", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lead") - 1)).alias("seq"), "owner")
    wanted = stored(own.unionByName(led), "warc-wanted")

    def number(batches):
        for t in runs(batches):
            yield from t.append_column("seq", pa.array(np.arange(t.num_rows))).to_batches()

    hit = wanted.select("file", "block").distinct()
    text = pieces(spark, path).join(near(hit), ["file", "block"], "left_semi") if small else pieces(spark, path)
    text = text.mapInArrow(number, "file string, block long, value string, seq long")
    got = text.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["file", "block", "seq"])
    got = got.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("p"))  # the pieces of one record
    whole = got.select("file", F.col("owner").alias("at"), F.array_join(F.col("p.value"), MAGIC).alias("value")).select("file", "at", *parsed(F.col("value"), payloads))
    return true.where("whole").select(*out).unionByName(whole.select(*out))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages in archives that `write` made."""
    told = stored(records(spark, path), "warc-records")
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+|null):", 1).try_cast("long")
    made = F.when(F.col("type") == "response", base32(F.upper("sha1"))).otherwise(F.col("digest"))
    size = F.when(F.col("type") == "response", F.col("bytes")).otherwise(F.col("told_bytes"))
    told = told.select("id", "refers", "type", "digest", made.alias("made"), size.alias("size"))
    targets = told.where("type = 'revisit'").groupBy("refers", "digest", "size").agg(F.count("*").alias("n"))
    lost = targets.join(told.where("type = 'response'").select(F.col("id").alias("refers"), F.col("digest").alias("own"), F.col("size").alias("own_size")), "refers", "left").where("own is null or own <> digest or own_size <> size")
    wrong = told.where("made is null or made <> digest or size is null").select("id").union(lost.select("refers")).limit(5).collect()
    if wrong:
        raise ValueError(f"records don't have their payload: {[r[0] for r in wrong]}")
    return told.select(page(F.col("id")).alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("refers")).alias("refers_to"))


def oracle(least: int = 0) -> str:
    """The same in DuckDB SQL over the view pages."""
    quad = " || ".join(f"substr('{BASE32}', (n // {32**k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))
    return f"""with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, octet_length(encode(body))::bigint as size, sha1(body) as hx, sha256(body) as sha from p),
b as (select *, list_aggregate(list_transform(list_transform(range(0, 8), lambda k: cast('0x' || substr(hx, 5 * k + 1, 5) as bigint)), lambda n: {quad}), 'string_agg', '') as digest from d),
k as (select *, case when size >= {least} then row_number() over (partition by sha order by page_id desc nulls last) else 1 end as k, first_value(page_id) over (partition by sha order by page_id desc nulls last) as top from b)
select page_id, size as payload_bytes, digest as payload_digest, case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then top end as refers_to from k"""
