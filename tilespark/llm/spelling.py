"""Spelling variants: words that one inserted, deleted or replaced letter tells apart, and the form each stands for.

Words are the maximal runs of Latin letters of all texts (A-Z lower-cased), from some length and number of
occurrences on. Full neighbourhood generation: each word emits all its distinct deletions, replacements and
insertions over the alphabet that the vocabulary has, and these meet the vocabulary in a hash join; a candidate
that is a word is near, and no distance is computed. A candidate is eight bytes: its polynomial hash follows from
the word's prefix sums, so a word of L letters costs (2L + 1) times the alphabet whatever L is. Candidates that a
Bloom filter of the vocabulary rules out aren't sent on; those that meet a word's hash are spelled out and compared
with it, so hashes that coincide don't matter. A filter holds FILTER_WORDS words; larger vocabularies are taken in
slices of the hash, one pass each, so what is broadcast has a bound and nothing is left out.

A word's form is its near word that occurs most (of equals the first in code-point order), if that is `times` as
often as the word itself. Forms are followed to the last one by pointer jumping; counts grow by `times` at each
step, so a few rounds do.

Null and empty texts have no words; a null doc_id counts as the empty text where occurrences are told apart. Repeated
rows count each time. Very long runs are words like others. An empty table, or one without words, gives an empty
result; columns beside doc_id and text don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import BROADCAST_ROWS, ascii_lower, discard, stored

#: Letters of words.
LETTERS = "A-Za-zÀ-ÿ"
#: Words in one filter, and its bits for each.
FILTER_WORDS, FILTER_BITS = 1 << 24, 16
#: Candidates that a task holds at once.
AT_ONCE = 1 << 21

BASE = 0x9E3779B97F4A7C15
U = np.uint64
DELETE, REPLACE, INSERT = 0, 1, 2


@dataclass(frozen=True)
class Rules:
    #: Letters and occurrences that words have at least.
    letters: int = 6
    occurrences: int = 5
    #: A form occurs so many times as often as the word.
    times: int = 5
    #: One occurrence in so many loses a letter before words are counted (0: none), told by doc_id and run.
    slip: int = 199


def occurrences(docs: DataFrame, r: Rules) -> DataFrame:
    """word: a row for each run of enough letters in a text."""
    low = LETTERS.replace("A-Z", "")
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"(?<![{low}])[{low}]{{{r.letters},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("word"))
    if not r.slip:
        return rows.select("word")
    rows = rows.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary")))
    at = F.pmod(F.col("_h"), F.char_length("word")).cast("int")
    less = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return rows.select(F.when(F.col("_h") % r.slip == 0, less).otherwise(F.col("word")).alias("word")).where(F.char_length("word") >= r.letters)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> np.ndarray:
    return np.r_[U(1), np.cumprod(np.full(n, BASE, U))]


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with words of one length, and their letters (all below 256) as a matrix."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, np.frombuffer(b"".join(raw[i] for i in rows), np.uint8).reshape(len(rows), n)


def prefix_sums(letters: np.ndarray) -> np.ndarray:
    """Of letter times BASE to the power of its place: a column for each prefix, the last one is the whole word."""
    n, size = letters.shape
    out = np.zeros((n, size + 1), U)
    np.cumsum(letters.astype(U) * powers(size)[:size], axis=1, out=out[:, 1:])
    return out


def with_keys(words: DataFrame) -> DataFrame:
    """word, n and key, the hash of the word."""

    def run(batches):
        for b in batches:
            key = np.zeros(b.num_rows, U)
            for rows, letters in by_length(b.column("word")):
                key[rows] = mixed(prefix_sums(letters)[:, -1])
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(key.view(np.int64))], names=["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
    """All distinct words at one edit from words of one length, AT_ONCE at most together: their keys and whether they
    count, by word, place and letter of the alphabet; the kind of edit; the first place."""
    n, size = letters.shape
    inverse = U(pow(BASE, -1, 1 << 64))
    pw, p = powers(size), prefix_sums(letters)
    whole, a = p[:, -1][:, None, None], alphabet.astype(U)[None, None, :]
    step = max(1, AT_ONCE // (n * len(alphabet)))
    for at in range(0, size + 1, step):
        i = np.arange(at, min(at + step, size + 1))
        own = letters[:, np.minimum(i, size - 1)][:, :, None]
        # a letter beside its like gives the same word on both sides: it goes after them
        yield mixed(p[:, i, None] + a * pw[i, None] + (whole - p[:, i, None]) * U(BASE)), (own != alphabet) | (i == size)[None, :, None], INSERT, at, n
        i = i[i < size]
        own = letters[:, i][:, :, None]
        yield mixed(whole + (a - own.astype(U)) * pw[i, None]), own != alphabet, REPLACE, at, n
        if size > least:
            after = letters[:, np.minimum(i + 1, size - 1)]
            yield mixed(p[:, i] + (whole[:, :, 0] - p[:, i + 1]) * inverse)[:, :, None], ((letters[:, i] != after) | (i == size - 1))[:, :, None], DELETE, at, n


def filter_places(key: Column, bits: int) -> Column:
    """The three bits of a key in a filter of so many bits (a power of two)."""
    return F.array(*[F.shiftrightunsigned(key, s).bitwiseAND(F.lit(bits - 1)) for s in (0, 20, 36)])


def bloom(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of a column of keys, aggregated by executors; bits / 64 numbers at most come back."""
    place = keys.select(F.explode(filter_places(F.col("key"), bits)).alias("p"))
    words = place.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["at"].to_numpy()] = words["v"].to_numpy()
    return out.view(U)


def maybe(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    mask = U(len(filter_) * 64 - 1)
    there = np.arange(len(keys))
    for s in (0, 20, 36):
        p = (keys[there] >> U(s)) & mask
        there = there[(filter_[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1) == 1]
    return there


def candidates(vocabulary: DataFrame, alphabet: list[int], r: Rules, filter_, part: int, parts: int) -> DataFrame:
    """word, key, kind, at, letter: the edits of all words whose key may be a word's, of one slice of keys."""
    letters_ = np.array(sorted(alphabet), np.uint8)

    def out(words: pa.Array, rows: np.ndarray, keys: np.ndarray, kind: int, at: np.ndarray, letter: np.ndarray) -> pa.RecordBatch:
        cols = [words.take(pa.array(rows)), pa.array(keys.view(np.int64)), pa.array(np.full(len(rows), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array([chr(c) for c in letter.tolist()], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=["word", "key", "kind", "at", "letter"])

    def run(batches):
        known = filter_.value
        for b in batches:
            words = b.column("word")
            for rows, letters in by_length(words):
                step = max(1, AT_ONCE // ((letters.shape[1] + 1) * len(letters_)))
                for lo in range(0, len(rows), step):
                    for keys, counts, kind, first, _ in neighbourhood(letters[lo : lo + step], letters_, r.letters):
                        counts = np.flatnonzero(np.broadcast_to(counts, keys.shape).ravel())
                        flat = keys.ravel()[counts]
                        if parts > 1:
                            own = np.flatnonzero((flat >> U(56)) % U(parts) == part)
                            counts, flat = counts[own], flat[own]
                        hit = maybe(known, flat)
                        if len(hit):
                            row, place, letter = np.unravel_index(counts[hit], keys.shape)
                            yield out(words, rows[lo : lo + step][row], flat[hit], kind, place + first, letters_[letter] if kind != DELETE else np.full(len(hit), 32))

    return vocabulary.select("word").mapInArrow(run, "word string, key long, kind int, at int, letter string")


def spelled() -> Column:
    """A candidate's letters."""
    before, rest = F.substring("word", F.lit(1), F.col("at")), F.char_length("word")
    skip = F.when(F.col("kind") == INSERT, F.col("at") + 1).otherwise(F.col("at") + 2)
    return F.concat(before, F.when(F.col("kind") == DELETE, "").otherwise(F.col("letter")), F.substring("word", skip, rest))


def near(vocabulary: DataFrame, n: int, r: Rules, filter_words: int = FILTER_WORDS) -> DataFrame:
    """word, near, near_n: both ways, each pair of near words once each way. vocabulary: word, n, key (n rows)."""
    spark = vocabulary.sparkSession
    alphabet = [ord(x[0]) for x in vocabulary.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()]  # 90 letters at most
    parts = max(1, -(-n // filter_words))
    bits = max(1 << 12, 1 << (FILTER_BITS * -(-n // parts) - 1).bit_length())
    words = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    out = None
    for part in range(parts):
        own = vocabulary.where(F.pmod(F.shiftrightunsigned("key", 56), F.lit(parts)) == part)
        known = spark.sparkContext.broadcast(bloom(own, bits))
        some = candidates(vocabulary.repartition(spark.sparkContext.defaultParallelism * 4), alphabet, r, known, part, parts)
        found = stored(some.join(words, "key").where(spelled() == F.col("near")).select("word", "near", "near_n"), "near-words")
        known.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def followed(forms: DataFrame, most_rounds: int = 40) -> DataFrame:
    """word, root: the last of the forms that follow one another, by pointer jumping. forms: word, form."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(most_rounds):
        n = at.count()
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(at.join(F.broadcast(beyond) if n <= BROADCAST_ROWS else beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        discard(at)
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at
    raise RuntimeError("forms did not settle")


def variants(docs: DataFrame, r: Rules = Rules(), filter_words: int = FILTER_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    counted = occurrences(docs, r).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= r.occurrences)
    vocabulary = stored(with_keys(counted), "vocabulary")
    found = near(vocabulary, vocabulary.count(), r, filter_words)
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    fits = F.col("b.m") * -1 >= F.col("n") * r.times
    judged = vocabulary.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.w")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n"))
    judged = stored(judged, "word-forms")
    roots = followed(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(r: Rules = Rules()) -> str:
    """The same in DuckDB SQL over the view documents; the checksum is computed byte by byte from its table."""
    low = LETTERS.replace("A-Z", "")
    return f"""with recursive t0(i, k, c) as (select range, 0, range from range(256) union all select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from t0 where k < 8),
crc as materialized (select i, c from t0 where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{low}]+')) as run from documents where text is not null),
occ as materialized (select doc_id, run, count(*) as n from runs where length(run) >= {r.letters} group by doc_id, run),
s(doc_id, run, hx, i, c) as (select doc_id, run, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)), 0, 4294967295 from occ
  union all select s.doc_id, s.run, s.hx, s.i + 1, xor(s.c // 256, t.c) from s join crc t on t.i = xor(s.c % 256, cast('0x' || substr(s.hx, 2 * s.i + 1, 2) as bigint)) where 2 * s.i < length(s.hx)),
h as (select doc_id, run, xor(c, 4294967295) as h from s where 2 * i = length(hx)),
w0 as (select case when h.h % {r.slip} = 0 then substr(run, 1, h.h % length(run)) || substr(run, h.h % length(run) + 2) else run end as word, occ.n from occ join h using (doc_id, run)),
v as materialized (select word, sum(n)::bigint as n from w0 where length(word) >= {r.letters} group by word having sum(n) >= {r.occurrences}),
cut as materialized (select distinct word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (select x.word, y.word as near, y.n as near_n from cut x join cut y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, v.word, v.n from cut x join v on v.word = x.a || x.b union select v.word, x.word, x.n from cut x join v on v.word = x.a || x.b),
best as (select word, near, near_n, row_number() over (partition by word order by near_n desc, encode(near)) as k, count(*) over (partition by word) as n_near from pairs),
f as materialized (select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= {r.times} * v.n then b.near end as form, case when b.near_n >= {r.times} * v.n then b.near_n end as form_n from v left join best b on b.word = v.word and b.k = 1),
chain(word, last, k) as (select word, word, 0 from f union all select c.word, f.form, c.k + 1 from chain c join f on f.word = c.last where f.form is not null)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join (select word, arg_max(last, k) as root from chain group by word) r on r.word = f.word"""
