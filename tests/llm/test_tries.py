"""The prefix trie against brute force over conversations with nulls, shared beginnings and copies, in blocks of every
size."""

import hashlib
import random
import zlib

import pytest

from tilespark.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, l string"


def brute(rows, how):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % how.most
        first = c - (abs(c) % how.group) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        n, saved = (0, (len(members[p]) - 1) * len(p[-1][1])) if p else (0, 0)
        for k in kids.get(p, []):
            a, b = below(k)
            n, saved = n + a, saved + b
        return n or 1, saved

    out = []
    for p, m in members.items():
        leaves, saved = below(p)
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check(spark, rows, how, block):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = convtrie.trie(df, how, block)
    assert tuple(got.columns) == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, how)


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 60, 4), (2, 250, 9), (3, 250, 400_000), (4, 9, 1), (5, 1, 5)])
def test_trie_equals_brute_force(spark, seed, n, block):
    rng = random.Random(seed)
    how = convtrie.Rebuild(group=rng.choice([3, 7, 100]), most=rng.choice([2, 6]))
    rows = [(None, 0, "user", "lost")]
    for c in rng.sample(range(-60, 600), n):
        turns = [rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 12]))] if rng.random() < 0.7 else ["a"] * rng.choice([1, 4, 9, 30])
        for k, t in enumerate(turns):
            rows.append((c, k if k else rng.choice([None, 0]), rng.choice(["u", "u", "u", None]), t * rng.choice([1, 1, 1, 5]) if rng.random() < 0.97 else None))
    check(spark, rows, how, block)


def test_many_copies_over_blocks(spark):
    """A third of all conversations are equal, and all share their first turns."""
    rows = [(c, k, "u", t) for c in range(180) for k, t in enumerate(["hello 🙂", "é" * 500, *(["same"] if c % 3 else [str(c)] * (c % 4))])]
    check(spark, rows, convtrie.Rebuild(group=10), 12)


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert convtrie.trie(empty).count() == 0
    assert convtrie.trie(spark.createDataFrame([(None, 1, "u", "x", 1, "y")], SCHEMA)).count() == 0


def test_turnless_conversations(spark):
    """Few turns and a group without a first conversation: nothing is left but the root."""
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    check(spark, [(c, 1, "u", "x")], convtrie.Rebuild(), 10)


def test_nearest_smaller_blocks():
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        values = [rng.randrange(5) for _ in range(n)]
        m = convtrie.Minima(values)
        for b in range(n):
            for v in range(6):
                assert m.before(b, v) == max((i for i in range(b) if values[i] < v), default=-1)
                assert m.after(b, v) == min((i for i in range(b + 1, n) if values[i] < v), default=n)
            for hi in range(b + 1, n + 1):
                assert m.over(b, hi) == min(values[b:hi])
