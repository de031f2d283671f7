"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its words and of the byte n-grams inside them, all hashed into
one table; a softmax over that mean gives the languages. Table and softmax are trained by stochastic
gradient descent in numpy, in one task, on a bounded sample: `per_lang` texts of each language, however many
languages there are. Each text is learned whole, and by random windows of `windows` words, as short texts are the hard
ones. Executors turn these into bucket shares, at most one number a bucket, so very long texts are no burden.
Prediction reads whole texts. A temperature and a rejection threshold are calibrated on windows and texts of the
sample that training doesn't see.

Null or letterless texts get `und` and score 0. Rows with a null lang are not learned from. An empty
table, or one without a learnable row, gives a model without languages, which answers `und`. Repeated
rows are judged alike; of languages with equal scores the first in the alphabet is given; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import chunked, fitted, frugal, held_out, sample_ids, small_batches, text_buffer
from tilespark.llm.textvec import LOWER, Hasher, U, words

#: Everything but ASCII letters and bytes of longer UTF-8 sequences parts words.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False


def features(data: np.ndarray, offs: np.ndarray, buckets: int, orders: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (bucket, text number): the words, then the n-grams of each order, each in text order."""
    low = LOWER[data]
    start, end, doc = words(low, offs, NOT_LETTER)
    h = Hasher(low)
    mask = U(buckets - 1)
    out = [((h.spans(start, end) & mask).astype(np.int32), doc)]
    if orders and len(start):
        size = end - start
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)
        left = np.repeat(end, size) - pos
        at = np.repeat(doc, size)
        for n in orders:
            ok = left >= n
            p = pos[ok]
            out.append(((((h.spans(p, p + n) ^ U(n * 0x9E3779B1)) * U(0x9E3779B97F4A7C15)) >> U(20) & mask).astype(np.int32), at[ok]))
    return out


def segment_sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by text; doc ascends."""
    out = np.zeros((n, values.shape[1]), np.float64)
    if len(doc):
        cut = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[cut]] = np.add.reduceat(values, cut, axis=0)
    return out


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.r_[0, np.cumsum(~NOT_LETTER[data] & (data < 128))]
    out = c[offs[1:]] > c[offs[:-1]]
    for i in np.flatnonzero(~out & (offs[1:] > offs[:-1])):
        out[i] = any(ch.isalpha() for ch in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class LanguageModel:
    """table: bucket -> contribution to each language's logit (embedding times softmax weights)."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    orders: tuple[int, ...] = (3, 4)
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        for idx, doc in features(data, offs, len(self.table), self.orders):
            total += segment_sum(self.table[idx], doc, n)
            count += np.bincount(doc, minlength=n)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        z = self.logits(data, offs) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and which answers calibration rejects as too unsure."""
        n = len(offs) - 1
        if not self.langs:
            return ["und"] * n, np.zeros(n), np.ones(n, bool)
        p = self.probabilities(data, offs)
        best, ok = p.argmax(1), has_letter(data, offs)
        score = np.where(ok, np.round(p.max(1), 6), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, ok, strict=True)], score, score < self.threshold


@dataclass
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    orders: tuple[int, ...] = (3, 4)
    epochs: int = 3
    rate: float = 1.0
    least_steps: int = 300
    batch: int = 32
    #: Words of the windows that are learned from beside the whole text: one of each length at a random place.
    windows: tuple[int, ...] = (2, 8, 40, 160)
    precision: float = 0.98
    seed: int = 11
    #: The bound of the training sample: texts of each language.
    per_lang: int = field(default=1000)


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64)


def examples(texts: list[str], s: Settings) -> list[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Of each text its windows, then the whole text: the buckets of each, and the share of features that fall there."""
    out = []
    for t in texts:
        raw = t.encode("utf-8", "replace")
        start, end, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        rng = np.random.default_rng([s.seed, zlib.crc32(raw)])
        cuts = []
        for size in s.windows:
            at = int(rng.integers(0, max(1, len(start) - size + 1)))
            cuts.append(raw[start[at] : end[min(at + size, len(end)) - 1]] if len(start) else b"")
        cuts.append(raw)
        offs = np.r_[0, np.cumsum([len(c) for c in cuts])].astype(np.int64)
        n = len(cuts)
        parts = features(np.frombuffer(b"".join(cuts), np.uint8), offs, s.buckets, s.orders)
        keys, counts = np.unique(np.concatenate([doc * s.buckets + idx for idx, doc in parts]), return_counts=True)
        edge = np.searchsorted(keys, np.arange(n + 1) * s.buckets)
        bucket = (keys % s.buckets).astype(np.int32)
        pairs = list(zip(edge[:-1], edge[1:], strict=True))
        out.append(([bucket[i:j] for i, j in pairs], [(counts[i:j] / max(1, counts[i:j].sum())).astype(np.float32) for i, j in pairs]))
    return out


def train(texts: list[str], langs: list[str], s: Settings = Settings()) -> LanguageModel:
    """Fits on texts and their languages; a fifth of the texts, by position, calibrates only."""
    return learned(examples(texts, s), langs, s)


def learned(given: list[tuple[list[np.ndarray], list[np.ndarray]]], langs: list[str], s: Settings) -> LanguageModel:
    """The same from the examples of each text."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], np.zeros((s.buckets, 0), np.float32), np.zeros(0), s.orders)
    rng = np.random.default_rng(s.seed)
    y_of = {k: i for i, k in enumerate(names)}
    each = [len(b) for b, _ in given]
    n = sum(each)
    y = np.repeat([y_of[k] for k in langs], each)
    calib = np.repeat(np.arange(len(given)) % 5 == 4, each)
    found = [b for buckets, _ in given for b in buckets]
    begin = np.r_[0, np.cumsum([len(b) for b in found])].astype(np.int64)
    idx, share = np.concatenate(found), np.concatenate([w for _, weights in given for w in weights])
    del found
    table = (rng.standard_normal((s.buckets, s.dim)) / s.dim).astype(np.float32)
    w_out, bias = np.zeros((s.dim, len(names))), np.zeros(len(names))
    learn = np.flatnonzero(~calib & (begin[1:] > begin[:-1]))
    epochs = max(s.epochs, -(-s.least_steps * s.batch // max(1, len(learn))))
    steps, step = max(1, epochs * -(-len(learn) // s.batch)), 0
    for _ in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), s.batch):
            b = learn[lo : lo + s.batch]
            lens = begin[b + 1] - begin[b]
            at = np.repeat(np.arange(len(b)), lens)
            rows = np.repeat(begin[b] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(int(lens.sum()))
            f, w = idx[rows], share[rows]
            h = segment_sum(table[f] * w[:, None], at, len(b))
            z = h @ w_out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            rate = s.rate * (1 - step / steps)
            step += 1
            dh = p @ w_out.T
            w_out -= rate * h.T @ p
            bias -= 0.1 * rate * p.mean(0)
            u, inv = np.unique(f, return_inverse=True)
            grad = np.stack([np.bincount(inv, dh[at, k] * w, len(u)) for k in range(s.dim)], 1)
            table[u] -= (rate * grad).astype(np.float32)
    model = LanguageModel(names, (table @ w_out).astype(np.float32), bias, s.orders)
    held = np.flatnonzero(calib & (begin[1:] > begin[:-1]))
    if len(held):
        z = np.stack([share[begin[i] : begin[i + 1]] @ model.table[idx[begin[i] : begin[i + 1]]] for i in held]) + bias
        yy = y[held]

        def loss(t: float) -> float:
            q = z / t
            q = q - q.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(yy)), yy]))

        model.temperature = min(np.geomspace(0.05, 10, 60), key=loss)
        p = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        conf, right = p.max(1), p.argmax(1) == yy
        o = np.argsort(-conf)
        good = np.flatnonzero(np.cumsum(right[o]) / np.arange(1, len(o) + 1) >= s.precision)
        model.threshold = float(conf[o[good[-1]]]) if len(good) else 1.0
    return model


def fit(docs: DataFrame, s: Settings = Settings()) -> LanguageModel:
    """Learns from text and lang of rows that aren't held out, `per_lang` of each language at most."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ids = sample_ids(rows.select("doc_id", "lang"), s.per_lang, "lang").select("doc_id").distinct()

    def cut(batches):
        for b in batches:
            made = [examples([t], s)[0] for t in b.column("text").to_pylist()]
            found = [pa.array([[list(x) for x in m[k]] for m in made], pa.list_(pa.list_(kind))) for k, kind in ((0, pa.int32()), (1, pa.float32()))]
            order = pa.array([zlib.crc32(t.encode("utf-8", "replace")) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), order, *found], names=["doc_id", "lang", "text_crc32", "buckets", "shares"])

    def work(table: pa.Table) -> LanguageModel:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "lang", "text_crc32")])
        cols = [[[np.asarray(x.values) for x in v] for v in table.column(c)] for c in ("buckets", "shares")]
        return learned(list(zip(*cols, strict=True)), table.column("lang").to_pylist(), s)

    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    picked = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang")
    return fitted(picked.mapInArrow(frugal(cut), f"doc_id {kind}, lang string, text_crc32 long, buckets array<array<int>>, shares array<array<float>>"), work)


def apply(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected (the answer is less sure than calibration asks)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        m = shared.value
        for b in batches:
            names, scores, rejected = [], [np.zeros(0)], [np.zeros(0, bool)]
            for _, _, data, offs in chunked(*text_buffer(b.column("text"))):
                a, s, r = m.predict(data, offs)
                names += a
                scores.append(s)
                rejected.append(r)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(rejected))], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(frugal(judge), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return apply(docs, fit(docs, s))
