"""The stages of the pipeline, each against brute force on its own input: nulls, repeated rows, other columns,
empty tables."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_llm import brute_classes, water

import corpus_pipeline
from tilespark.llm import queries, simjoin, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _b int"
WORDS = [a + b for a in ("lo", "mi", "ra", "te", "su", "ne", "ka", "po") for b in ("n", "r", "st", "l", "m", "d", "ff", "x")]


def rows():
    rng, out = random.Random(3), []
    place = lambda: (rng.choice(["en", "en", "es", None]), rng.choice(["src1", "src2", "src12", None]))
    for i in range(600):
        w = [rng.choice(WORDS) for _ in range(rng.randint(8, 40))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = w[rng.randrange(len(w))] = rng.choice(["idiot", "clown", "scum"])
        out.append((i, " ".join(w), *place()))
    for k, (i, t, *_) in enumerate(out[1:600:5]):
        out.append((1000 + k, t.upper() if k % 2 else t, *place()))  # exact copies
        out.append((2000 + k, t + " more", *place()))  # near copies of the longer ones
    out += [(7, out[11][1], "en", "src1"), (7, "a text of its own", "en", "src1"), *[out[21]] * 3]
    out += [(None, "lost", None, None)] * 2 + [(3000, None, "en", "src1"), (3001, "", "es", None), (3002, "é ß 漢字 🙂", None, "src2")]
    return [(*r, len(r[1] or ""), "x", 1) for r in out]


def low(t):
    return (t or "").encode().lower()


def not_toxic(spark, docs, d, got):
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    score = lambda t: model.score(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0]
    return [r for r in got if score(r[1]) < model.settings.cut]


def without_copies(rows):
    best: dict = {}
    for r in rows:
        best[low(r[1])] = max(best.get(low(r[1]), -1), -1 if r[0] is None else r[0])
    return Counter((None if i < 0 else i, t) for t, i in best.items())


def without_near_copies(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    found = brute_classes([(k, r[1]) for k, r in enumerate(ordered)], simjoin.Threshold(words=5, num=80, den=100))
    return Counter(ordered[k] for k, _, c in found if k == c)


def check_mix(before, after):
    rate = getattr(queries, "BYTES_PER_TOKEN", {})
    size = lambda r: max(1, math.ceil(len((r[1] or "").encode()) / rate.get(r[2], rate.get(None, 4))))
    path = lambda r: ("web" if r[3] in ("src1", "src2") else "books", r[2] or "?", r[3] or "?")
    tokens, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        tokens[path(r)] += size(r)
        largest[path(r)] = max(largest[path(r)], size(r))
    for r in after:
        taken[path(r)] += size(r)
    own, times = Counter(before), Counter(after)
    assert all(r in own and n <= 2 * own[r] for r, n in times.items())
    given = {("web",): 0.55, ("books",): 0.45, ("web", "en"): 0.5, ("books", "en"): 0.5}

    def down(prefix, budget):
        if len(prefix) == 3:
            assert -1 <= taken[prefix] - budget <= largest[prefix] + 1, prefix
            return
        kids = sorted({p[: len(prefix) + 1] for p in tokens if p[: len(prefix)] == prefix})
        free = [k for k in kids if k not in given]
        rest = max(0.0, 1 - sum(given.get(k, 0) for k in kids))
        nodes = [(given.get(k, rest / len(free) if free else 0), 2 * sum(v for p, v in tokens.items() if p[: len(k)] == k)) for k in kids]
        for k, b in zip(kids, water(budget, nodes), strict=True):
            down(k, b)

    down((), 0.9 * sum(tokens.values()))


def test_stages(spark, tmp_path):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    d, given = str(tmp_path), rows()
    spark.createDataFrame(given, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(0, 600)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), given
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        out = spark.read.parquet(f"{d}/{name}")
        got = [tuple(r) for r in out.collect()]
        if name == "toxicity":
            assert Counter(got) == Counter(not_toxic(spark, docs, d, kept)) and 0 < len(got) < len(kept)
        elif name == "exact_dedup":
            assert Counter((r[0], low(r[1])) for r in got) == without_copies(kept) and not Counter(got) - Counter(kept) and len(got) < len(kept)
        elif name == "ngram_join":
            assert Counter(got) == without_near_copies(kept) and len(got) < len(kept)
        elif name == "mixing":
            check_mix(kept, got)
        else:
            want = []
            for r in kept:
                ids = lib.encode(r[1] or "", add_special_tokens=False).ids
                want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
            assert Counter(got) == Counter(want)
        if name != "bpe":
            assert out.columns == docs.columns
        docs, kept = out, got


@pytest.mark.parametrize("name", ["exact_dedup", "ngram_join"])
def test_repeated_rows_in_any_stage(spark, tmp_path, name):
    given = rows()[:60] + rows()[-15:] * 2
    spark.createDataFrame(given, SCHEMA).write.parquet(f"{tmp_path}/d")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)[name](spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    assert not Counter(got) - Counter(given)
    if name == "exact_dedup":
        assert Counter((r[0], low(r[1])) for r in got) == without_copies(given)
    else:
        bare = {r[0] for r in given if not low(r[1]).split()}
        assert Counter(r for r in got if r[0] not in bare) == Counter({r: n for r, n in without_near_copies(given).items() if r[0] not in bare})
        assert Counter(r[0] for r in got if r[0] in bare) == Counter(bare)  # without words: one of each id


def test_run_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
