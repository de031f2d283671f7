"""The rows of a mix against a plain loop: budgets by water filling, prefixes row by row."""

import math
import random
from collections import Counter, defaultdict
from itertools import groupby

from pyspark.sql import functions as F
from test_llm import water

from tilespark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, rest string, end int, before int, _b string, _mix_path string, _Path string"


def size(t):
    return max(1, math.ceil(len((t or "").encode()) / 4))


def test_rows_equal_a_plain_loop(spark):
    rng = random.Random(5)
    names = ["a", "b", "a/b", "b/c", "?", None, "", "\\", "a\\/b"]
    rows = [(None if i % 40 == 0 else i, "x" * rng.randint(0, 300) if i % 30 else None, rng.choice(names), rng.choice(names), "r", 1, 2, "b", "p", "gone") for i in range(2500)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan = mixing.Plan([("lang", F.col("lang")), ("source", F.col("source"))], {"a": 0.5, "?": 0.3}, total=0.8, epochs=2, bits=4, rounds=2)
    order = {}
    for e in (0, 1, 2):
        key = F.struct(F.shiftrightunsigned(F.xxhash64(F.lit(plan.seed), F.lit(e), "doc_id", mixing.tokens(F.col("text"))), 1), "doc_id", mixing.tokens(F.col("text")))
        for r in docs.select("doc_id", mixing.tokens(F.col("text")).alias("t"), key.alias("k")).collect():
            order[e, r["doc_id"], r["t"]] = tuple(-1 if v is None else v for v in r["k"])
    leaf = defaultdict(list)
    for r in rows:
        leaf[r[2], r[3]].append(r)
    cap = {k: sum(size(r[1]) for r in v) for k, v in leaf.items()}
    langs = sorted({k[0] for k in leaf}, key=str)
    given = {"a": 0.5, None: 0.3}
    free = [x for x in langs if x not in given]
    w = [given.get(x, 0.2 / len(free)) for x in langs]
    top = water(0.8 * sum(cap.values()), [(q, 2 * sum(c for k, c in cap.items() if k[0] == x)) for q, x in zip(w, langs, strict=True)])
    want: Counter = Counter()
    for x, b in zip(langs, top, strict=True):
        own = sorted((k for k in leaf if k[0] == x), key=str)
        for k, share in zip(own, water(b, [(1 / len(own), 2 * cap[k]) for k in own]), strict=True):
            budget = math.floor(share + 0.5)
            e, left = divmod(budget, cap[k])
            for r in leaf[k]:
                for j in range(e):
                    want[r[:9], j] += 1
            at = 0
            for r in sorted(leaf[k], key=lambda r: order[e, r[0], size(r[1])]):
                if at >= left:
                    break
                want[r[:9], e] += 1
                at += size(r[1])
    got = mixing.mix(docs, plan)
    assert got.columns == ["doc_id", "text", "lang", "source", "rest", "end", "before", "_b", "_mix_path", "_path", "_tokens", "_epoch"]
    # which of several rows with an id and a size is taken is told by their place in the files: those are alike here
    alike = lambda c: Counter({k: sum(n for _, n in g) for k, g in groupby(sorted((((r[0], r[2], r[3], size(r[1]), e), n) for (r, e), n in c.items()), key=lambda x: repr(x[0])), key=lambda x: x[0])})
    found = Counter((tuple(r)[:9], r["_epoch"]) for r in got.collect())
    assert alike(found) == alike(want) and {r for r, _ in found} <= {r[:9] for r in rows}
    assert len({r["_path"] for r in got.select("_path").distinct().collect()}) == len({k for k in leaf if any(n for (r, _), n in want.items() if (r[2], r[3]) == k)})


def test_different_values_have_different_paths(spark):
    docs = spark.createDataFrame([(i, "word" * 5, lang, s) for i, (lang, s) in enumerate([("a/b", "c"), ("a", "b/c"), ("?", "x"), (None, "x"), ("\\?", "x")] * 20)], "doc_id long, text string, lang string, source string")
    plan = mixing.Plan([("lang", F.col("lang")), ("source", F.col("source"))], {}, total=1.0, epochs=1)
    got = mixing.mix(docs, plan)
    assert got.count() == 100 and got.select("_path").distinct().count() == 5


def test_rows_alike_are_taken_one_by_one(spark):
    """Without ids all rows of a size are ties, and the budget still holds."""
    docs = spark.createDataFrame([(None, "same text", "en", "s")] * 1000, "doc_id long, text string, lang string, source string")
    plan = mixing.Plan([("lang", F.col("lang"))], {}, total=0.1, epochs=1)
    assert mixing.mix(docs, plan).count() == 100
