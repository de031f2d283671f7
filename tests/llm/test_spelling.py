"""Spelling variants against brute force, with slices of the vocabulary, very long words, nulls and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest

from tilespark.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, KEY string"


def brute(rows, r):
    count = {}
    for i, text in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if r.slip and h % r.slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= r.letters:
                count[run] = count.get(run, 0) + 1
    words = {w: n for w, n in count.items() if n >= r.occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in found.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= r.times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), words[w], len(found[w]), words[form[w]] if form[w] else None) for w in words)


def check(spark, rows, r, **more):
    df = spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], SCHEMA)
    got = spelling.variants(df, r, **more)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(x) for x in got.collect()) == brute(rows, r)


def texts(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé") for _ in range(rng.choice([3, 4, 5]))) for _ in range(12)]
    weight = [6**k for k in range(4)]
    word = lambda: rng.choice(base) + rng.choices(["", "a", "ab", "ÿ"], weight[::-1])[0]
    rows = [(i if i % 9 else None, rng.choice([" ", "-", "1", "  ", "’"]).join(word() if rng.random() < 0.5 else word().upper() for _ in range(30))) for i in range(n)]
    return [*rows, (1, None), (2, ""), (3, "12 !?"), *rows[:4]]


@pytest.mark.parametrize(("seed", "r"), [(1, spelling.Rules(3, 2, 3, 5)), (2, spelling.Rules(4, 5, 5, 199)), (3, spelling.Rules(3, 1, 2, 0))])
def test_variants_equal_brute_force(spark, seed, r):
    check(spark, texts(seed), r)


def test_vocabulary_in_slices(spark):
    check(spark, texts(5), spelling.Rules(3, 1, 2, 7), filter_words=20)


def test_very_long_words(spark):
    a = "ab" * 3000
    rows = [(i, f"{a} {a[:-1]} {a}x {a[1:]} short") for i in range(4)] + [(9, a)] * 30
    check(spark, rows, spelling.Rules(6, 3, 5, 0))


def test_no_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "a b c")]):
        assert spelling.variants(spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], SCHEMA)).count() == 0


@pytest.mark.parametrize("word", ["aab", "abc", "zzzz", "àÿa"])
@pytest.mark.parametrize("at_once", [7, 1 << 20])
def test_neighbourhood_is_whole_and_distinct(monkeypatch, word, at_once):
    monkeypatch.setattr(spelling, "AT_ONCE", at_once)
    alphabet = np.array(sorted(b"abz\xe0\xff"), np.uint8)
    letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None, :]
    keys = np.concatenate([k.ravel()[np.flatnonzero(np.broadcast_to(ok, k.shape).ravel())] for k, ok, *_ in spelling.neighbourhood(letters, alphabet, 0)])
    abc = [chr(c) for c in alphabet]
    want = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in abc} | {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in ["", *abc]}
    want.discard(word)
    own = [spelling.mixed(spelling.prefix_sums(np.frombuffer(w.encode("latin-1"), np.uint8)[None, :])[:, -1])[0] for w in want]
    assert sorted(keys.tolist()) == sorted(int(k) for k in own)
