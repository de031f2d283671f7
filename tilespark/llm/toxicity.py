"""Toxicity: a convolutional text classifier on hashed word embeddings.

A word is the sum of hashed embeddings of the word and of its beginnings; filters of widths 1, 2 and 3
slide over the words of the whole text, each keeps its maximum, and a logistic layer weighs the maxima.
Trained in numpy, in one task, on the whole texts of a bounded sample (`positives` and `negatives` labelled rows at most). The decision
threshold is calibrated for each language that a small word model reads from the text itself: it is the
language's own in so far as calibration texts tell (`trust` of a kind weigh as much as all languages together),
else the general one; scores are shifted so that each language's threshold falls on `cut`. That word model
learns from 400 texts of each language, whole and by windows of 20 and 100 words.

Null and empty texts are scored as texts without words; very long ones are scored whole. Without labelled rows
of both kinds, the score is 0 for all. Repeated ids are scored by row; a document with several labels is toxic if
one says so. Rows of the sample are picked by a hash of their id, ties by the id. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tilespark.llm import langid
from tilespark.llm.common import chunked, fitted, frugal, held_out, sample_ids, small_batches, text_buffer
from tilespark.llm.textvec import LOWER, Hasher, U, words


@dataclass
class Settings:
    buckets: int = 1 << 18
    least_texts: int = 3
    decay: float = 1e-3
    dim: int = 16
    beginnings: tuple[int, ...] = (4, 5, 6)
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 12
    epochs: int = 8
    rate: float = 0.05
    least_steps: int = 400
    batch: int = 32
    positives: int = 1500
    negatives: int = 2000
    cut: float = 0.3
    trust: int = 20
    seed: int = 5


def word_fields(data: np.ndarray, offs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (the word, then its beginnings; bucket 0 stands for none), and its text."""
    low = LOWER[data]
    start, end, doc = words(low, offs, langid.NOT_LETTER)
    h = Hasher(low)
    mask = U(s.buckets - 1)
    out = np.zeros((len(start), 1 + len(s.beginnings)), np.int32)
    out[:, 0] = (h.spans(start, end) & mask) | U(1)
    for k, n in enumerate(s.beginnings):
        ok = end - start >= n
        out[ok, k + 1] = (h.spans(start[ok], start[ok] + n) * U(2 * n + 1)) >> U(64 - s.buckets.bit_length() + 1)
    return out, doc


@dataclass
class ToxicityModel:
    settings: Settings
    table: np.ndarray
    kernels: list[np.ndarray]  # for each width: (width, dim, filters)
    shifts: list[np.ndarray]
    out: np.ndarray
    bias: float
    reader: langid.LanguageModel | None = None
    thresholds: np.ndarray | None = None
    slope: float = 1.0

    def embed(self, fields: np.ndarray) -> np.ndarray:
        x = self.table[fields[:, 0]]
        for k in range(1, fields.shape[1]):
            x = x + self.table[fields[:, k]]
        return x

    def pooled(self, x: np.ndarray, doc: np.ndarray, n: int, where: bool = False):
        """Maxima of each filter over each text (0 at least), and where they are if asked."""
        total = len(self.out)
        top, pos = np.zeros((n, total), np.float32), np.full((n, total), -1, np.int64)
        if not len(doc):
            return top, pos
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        at = 0
        for kernel, shift in zip(self.kernels, self.shifts, strict=True):
            c = x @ kernel[0] + shift
            for j in range(1, len(kernel)):
                c[:-j] += (x[j:] @ kernel[j]) * (doc[j:] == doc[:-j])[:, None] if len(doc) > j else 0
            best = np.maximum.reduceat(c, cut, axis=0)
            f = c.shape[1]
            top[doc[cut], at : at + f] = np.maximum(best, 0)
            if where:
                hit = c == np.repeat(best, np.diff(np.r_[cut, len(doc)]), axis=0)
                for q in range(f):
                    i = np.flatnonzero(hit[:, q])
                    d, first = np.unique(doc[i], return_index=True)
                    pos[d, at + q] = i[first]
            at += f
        pos[top <= 0] = -1
        return top, pos

    def raw(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        fields, doc = word_fields(data, offs, self.settings)
        top, _ = self.pooled(self.embed(fields), doc, len(offs) - 1)
        return top @ self.out + self.bias

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.raw(data, offs).astype(np.float64)
        t = self.thresholds
        if self.reader is not None and self.reader.langs:
            t = t[self.reader.logits(data, offs).argmax(1)]
        cut = self.settings.cut
        return np.round(1 / (1 + np.exp(-np.clip(self.slope * (z - t) + np.log(cut / (1 - cut)), -40, 40))), 6)


def train(texts: list[str], toxic: list[int], reader: langid.LanguageModel | None, s: Settings = Settings()) -> ToxicityModel:
    rng = np.random.default_rng(s.seed)
    total = s.filters * len(s.widths)
    m = ToxicityModel(
        s, (rng.standard_normal((s.buckets, s.dim)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, s.dim, s.filters)) * (0.5 / np.sqrt(w))).astype(np.float32) for w in s.widths],
        [np.zeros(s.filters, np.float32) for _ in s.widths], (rng.standard_normal(total) * 0.1).astype(np.float32), 0.0, reader,
    )
    m.table[0] = 0
    y = np.asarray(toxic, np.float32)
    n_lang = max(1, len(reader.langs) if reader else 0)
    m.thresholds = np.zeros(n_lang)
    if not len(y) or y.min() == y.max():
        m.out[:] = 0
        m.bias = 0.0 if len(y) and y.min() == 1 else -40.0
        return m
    data, offs = langid.encode(texts)
    parts, counts = [], []
    for i, j, d, o in chunked(data, offs):
        a, b = word_fields(d, o, s)
        parts.append(a)
        counts.append(np.bincount(b, minlength=j - i))
    del data
    fields = np.concatenate(parts)
    del parts
    begin = np.r_[0, np.cumsum(np.concatenate(counts))]
    # what fewer texts hold than least_texts says nothing general: its embedding is and stays zero
    df = np.zeros(s.buckets, np.int32)
    for i in range(len(y)):
        df[np.unique(fields[begin[i] : begin[i + 1]])] += 1
    rare = df < s.least_texts
    m.table[rare] = 0
    for lo in range(0, len(fields), 1 << 18):
        part = fields[lo : lo + (1 << 18)]
        part[rare[part]] = 0
    calib = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~calib)
    weight = np.where(y == 1, 0.5 / max(y[learn].mean(), 1e-6), 0.5 / max(1 - y[learn].mean(), 1e-6))
    # Adam for the dense parameters, Adagrad for the rows of the table: each step touches few of them.
    dense = [*m.kernels, *m.shifts, m.out]
    mo, ve = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    seen = np.full(s.buckets, 1e-3, np.float32)
    t = 0
    epochs = max(s.epochs, -(-s.least_steps * s.batch // max(1, len(learn))))
    for epoch in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), s.batch):
            b = np.sort(learn[lo : lo + s.batch])
            rows = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in b])
            local = np.repeat(np.arange(len(b)), begin[b + 1] - begin[b])
            fl = fields[rows]
            x = m.embed(fl)
            top, pos = m.pooled(x, local, len(b), True)
            g = (1 / (1 + np.exp(-(top @ m.out + m.bias))) - y[b]) * weight[b] / len(b)
            d_out, d_top = top.T @ g, g[:, None] * m.out[None, :]
            d_top[pos < 0] = 0
            d_x = np.zeros_like(x)
            grads_k, grads_s, at = [], [], 0
            for kernel in m.kernels:
                f = kernel.shape[2]
                p, dt = pos[:, at : at + f], d_top[:, at : at + f]
                gk = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    e = p + j
                    ok = (p >= 0) & (e < len(x))
                    ok[ok] = local[e[ok]] == local[p[ok]]
                    d, q = np.nonzero(ok)
                    if len(d):
                        v = dt[d, q]
                        r = e[d, q]
                        np.add.at(gk[j].T, q, x[r] * v[:, None])
                        np.add.at(d_x, r, kernel[j][:, q].T * v[:, None])
                grads_k.append(gk)
                grads_s.append(dt.sum(0))
                at += f
            t += 1
            rate = s.rate * (1 - epoch / epochs)
            for k, (p, gr) in enumerate(zip(dense, [*grads_k, *grads_s, d_out], strict=True)):
                mo[k] = 0.9 * mo[k] + 0.1 * gr
                ve[k] = 0.99 * ve[k] + 0.01 * gr * gr
                p -= (rate * 0.5 * (mo[k] / (1 - 0.9**t)) / (np.sqrt(ve[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
                if p.ndim == 3:
                    p *= 1 - rate * s.decay
            m.bias -= rate * float(g.sum())
            hit = np.flatnonzero(np.abs(d_x).sum(1))
            for k in range(fl.shape[1]):
                idx = fl[hit, k]
                keep = idx > 0
                u, inv = np.unique(idx[keep], return_inverse=True)
                gr = np.zeros((len(u), s.dim), np.float32)
                np.add.at(gr, inv, d_x[hit][keep])
                seen[u] += (gr * gr).mean(1)
                m.table[u] -= rate * gr / np.sqrt(seen[u])[:, None]
    held = np.flatnonzero(calib)
    pick = held if len(np.unique(y[held])) == 2 else np.arange(len(y))
    pd, po = langid.encode([texts[i] for i in pick])
    z, yy = np.concatenate([m.raw(d, o) for _, _, d, o in chunked(pd, po)]).astype(np.float64), y[pick]
    general = best_threshold(z, yy)
    m.thresholds[:] = general
    m.slope = float(min(4.0, 4.0 / max(1e-3, abs(np.median(z[yy == 1]) - np.median(z[yy == 0])) / 2)))
    if reader is not None and reader.langs:
        lang = np.concatenate([reader.logits(d, o).argmax(1) for _, _, d, o in chunked(pd, po)])
        for k in range(n_lang):
            own = lang == k
            least = min((yy[own] == 1).sum(), (yy[own] == 0).sum())
            if least:
                weight = least / (least + s.trust)
                m.thresholds[k] = weight * best_threshold(z[own], yy[own]) + (1 - weight) * general
    return m


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between scores at which the balanced accuracy is highest."""
    o = np.argsort(z)
    z, y = z[o], y[o]
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    gain = np.r_[0, np.cumsum(np.where(y == 0, 1 / n0, -1 / n1))]
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edge = np.r_[z[0] - 1, z, z[-1] + 1]
    return float(np.mean([(edge[k] + edge[k + 1]) / 2 for k in best]))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), lang: langid.Settings | None = None) -> ToxicityModel:
    """Learns labels.toxic of rows that aren't held out. Languages for the calibration are read from the
    texts by a word model, itself learned from rows that aren't held out."""
    reader = langid.fit(docs, lang or langid.Settings(orders=(), per_lang=400, windows=(20, 100), epochs=2, buckets=1 << 14))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    marks = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = marks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
    ids = sample_ids(known.where("toxic = 1"), s.positives).union(sample_ids(known.where("toxic <> 1"), s.negatives))

    def work(table: pa.Table) -> ToxicityModel:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return train(table.column("text").to_pylist(), [int(v == 1) for v in table.column("toxic").to_pylist()], reader, s)

    small_batches(docs.sparkSession)
    return fitted(rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic"), work)


def scored(docs: DataFrame, model: ToxicityModel, columns: list[str]) -> DataFrame:
    """The columns of docs of these names as c0, c1, ..., with score and predicted: no name of docs can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    places = [docs.columns.index(c) for c in columns]
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = f"c{docs.columns.index('text')}"
    own = [f"c{i}" for i in places]
    kept = plain.select(*own) if text in own else plain.select(*own, text)
    fields = [StructField(f"c{k}", plain.schema[c].dataType) for k, c in enumerate(own)]

    def judge(batches):
        m = shared.value
        for b in batches:
            z = np.concatenate([np.zeros(0), *(m.score(d, o) for _, _, d, o in chunked(*text_buffer(b.column(text))))])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(z), pa.array((z >= m.settings.cut).astype(np.int32))], names=[*(f"c{k}" for k in range(len(own))), "score", "predicted"])

    small_batches(docs.sparkSession)
    return kept.mapInArrow(frugal(judge), StructType([*fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def apply(docs: DataFrame, model: ToxicityModel, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (doc_id if none are given) with score and predicted; a column of docs called score or
    predicted, in any case, gives way."""
    keep = [c for c in (columns or ["doc_id"]) if c.lower() not in ("score", "predicted")]
    return scored(docs, model, keep).toDF(*keep, "score", "predicted")


def reject(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs without the documents that the classifier finds toxic; all columns stay as they are, whatever their names."""
    kept = scored(docs, fit(docs, labels, s), docs.columns).where("predicted = 0").drop("score", "predicted")
    return kept.toDF(*docs.columns)
