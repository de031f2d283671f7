"""Which pairs come to be compared on their words: only those that sketches allow to link."""

import random

import pytest
from test_llm import brute_classes, make

from tilespark.llm import simjoin


def counted(monkeypatch):
    """How many pairs each call of verified gets, once the join has run."""
    seen, was = [], simjoin.verified

    def verified(pairs, docs, t):
        seen.append(pairs.count())
        return was(pairs, docs, t)

    monkeypatch.setattr(simjoin, "verified", verified)
    return seen


def shared_passage(n, seed):
    """n texts of one passage and as many words of their own, in which nothing links."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(60)]
    return [" ".join(passage + [word() for _ in range(60)]) for _ in range(n)]


def near_copies(n, seed):
    rng = random.Random(seed)
    text = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    return [" ".join(text[:k] + [f"x{rng.randrange(10**6)}"] + text[k + 1 :]) for k in (rng.randrange(1, 79) for _ in range(n))]


def test_a_common_passage_brings_no_texts_together(spark, monkeypatch):
    seen = counted(monkeypatch)
    rows = list(enumerate(shared_passage(120, 1)))
    t = simjoin.Threshold(3, 70, 100)
    assert {tuple(r) for r in simjoin.classes(make(spark, rows), t).collect()} == brute_classes(rows, t)
    assert sum(seen) <= len(rows)  # the head and eight neighbours of each before


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_links_beside_a_common_passage(spark, monkeypatch, bound):
    """Whether sketches are broadcast or shuffled, near copies are found among texts that share a passage."""
    monkeypatch.setattr(simjoin, "BROADCAST_BYTES", bound)
    rows = list(enumerate(shared_passage(60, 2) + near_copies(60, 3)))
    random.Random(4).shuffle(rows)
    t = simjoin.Threshold(3, 70, 100)
    found = {tuple(r) for r in simjoin.classes(make(spark, rows), t).collect()}
    assert found == brute_classes(rows, t)
    assert len({c for _, _, c in found}) == 61


def test_sketches_allow_every_link(spark):
    rows = list(enumerate(near_copies(30, 5) + shared_passage(20, 6) + ["a b", "a b c d"]))
    t = simjoin.Threshold(3, 70, 100)
    docs = make(spark, rows)
    sets = {i: {tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))} for i, w in ((i, x.split()) for i, x in rows)}
    pairs = [(i, j, len(sets[i]), len(sets[j])) for i in sets for j in sets if i < j]
    drawn = simjoin.sketches(docs, spark.createDataFrame([(i,) for i in sets], "rep long"), t)
    left = {tuple(r) for r in simjoin.allowed(spark.createDataFrame(pairs, "a long, b long, na int, nb int"), drawn, t).collect()}
    linked = {(i, j) for i, j, m, n in pairs if t.linked(len(sets[i] & sets[j]), m, n)}
    assert linked and linked <= left
    assert len(left) < len(pairs) / 2  # also where sketches have different widths
