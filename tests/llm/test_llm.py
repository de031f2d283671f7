"""Each operator against brute force, round trips or held-out accuracy, on small fixtures with nulls, empty and
long texts, repeated rows, clashing column names and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.llm import bpe, common, dedup, flac, langid, mixing, sharding, simjoin, tokenstore, toxicity, urlfilter
from tilespark.llm.queries import RULES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, keep_id string, _b int"


def make(spark, rows):
    """Documents from (doc_id, text[, lang, source]), with columns whose names clash with results."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), 0.5, "x", 1) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n"), (4, "é ß 漢字 🙂"), (5, "word " * 60_000), (6, "Same Text here"), (7, "same text HERE"), (7, "same text HERE"), (8, "É"), (9, "é"), (10, "a\tb\x00c <|endoftext|> d"), (None, "lost"), (11, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    return make(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, []).where("false")


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


# ---- 10: BPE


def test_bpe_equals_library(spark, odd, empty):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(path("byte_bpe_50k.json"))
    got = [r.asDict() for r in bpe.roundtrip(odd, path("byte_bpe_50k.json"), keep_ids=True).collect()]
    assert len(got) == len(ODD)
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(t or "")
    for r in got:
        ids = lib.encode(texts[r["doc_id"]][0], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.roundtrip(empty, path("byte_bpe_50k.json")).count() == 0


def test_bpe_on_random_texts():
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(path("byte_bpe_50k.json"))
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        b = bpe.Bpe(f.read())
    rng = random.Random(4)
    letters = "abeit 's'll \n\n\t  .,!éÉ漢🙂\u00a0\u2009\u200b12²Ⅷ\x1c\x85<|endoftext|>ñ\u0303'reZZZ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["a" * 4000, "=-" * 900]
    ids, at = b.encode_batch(texts)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, t


# ---- 9: token store


def test_token_store(spark, odd, empty, tmp_path):
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(path("word_bpe_49k.json"))
    for name, docs, rows in (("odd", odd, ODD), ("empty", empty, [])):
        at = str(tmp_path / name)
        tokenstore.write(docs, at, path("word_bpe_49k.json"))
        got = tokenstore.read_back(spark, at).orderBy("start").collect()
        start = 0
        for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
            ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    whole = {r["start"]: r["ids"] for r in tokenstore.reconstruct(spark, str(tmp_path / "odd")).collect()}
    assert sum(map(len, whole.values())) == max(whole) + len(whole[max(whole)])
    assert spark.read.parquet(str(tmp_path / "odd/chunks")).groupBy("digest").count().where("count > 1").count() == 0


def test_damaged_store_raises(spark, tmp_path):
    at = str(tmp_path / "s")
    tokenstore.write(make(spark, [(i, f"text number {i} " * 50) for i in range(5)]), at, path("word_bpe_49k.json"))
    c = spark.read.parquet(f"{at}/chunks")
    bad = c.withColumn("payload", F.concat(F.substring("payload", 1, 2), F.col("payload")))
    bad.write.parquet(f"{at}/bad")
    common.remove(spark, f"{at}/chunks")
    spark.read.parquet(f"{at}/bad").write.parquet(f"{at}/chunks")
    with pytest.raises(Exception, match="damaged"):
        tokenstore.read_back(spark, at).collect()


def test_crc_join():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 4096, 100_001):
        a, b = rng.bytes(77), rng.bytes(n)
        assert tokenstore.crc_join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


# ---- 4: FLAC


def test_flac_column(spark, odd, empty):
    rows = {(r["doc_id"], r["payload_sha256"]) for r in flac.read_media(flac.text_media(odd)).collect()}
    want = set()
    for i, t in ODD:
        raw = (t or "").encode()
        want.add((i, hashlib.sha256(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))).hexdigest()))
    assert rows == want
    assert flac.read_media(flac.text_media(empty)).count() == 0
    blocks = flac.pcm_blocks(flac.text_media(odd.where("doc_id in (4, 5)"))).orderBy("doc_id", "block").collect()
    joined = defaultdict(bytes)
    for b in blocks:
        assert b["sample_offset"] == len(joined[b["doc_id"]])
        joined[b["doc_id"]] += bytes(b["pcm"])
    assert joined[5].rstrip(b"\0").decode() == "word " * 60_000


def test_flac_codec():
    rng = np.random.default_rng(1)
    t = np.arange(9000)
    runs = [rng.integers(0, 256, 64), np.full(4096, 7), 128 + 100 * np.sin(t / 30), np.cumsum(rng.integers(-1, 2, 5000)) % 256, np.where(t % 900 == 0, 255, 120)]
    data = np.concatenate(runs).astype(np.uint8)
    offs = np.r_[0, np.cumsum([len(r) for r in runs])]
    streams = flac.encode(data, offs)
    back, at = flac.decode(streams)
    assert (back == data).all() and (at == offs).all()
    assert flac.encode(data[offs[2] : offs[3]], np.array([0, 9000]))[0] == streams[2]  # whatever its neighbours are
    assert len(streams[2]) < 5000 and len(streams[1]) < 200
    assert flac.read_samples(streams[2], 2000, 3000) == data[offs[2] + 2000 : offs[2] + 5000].tobytes()
    for place, message in ((len(streams[3]) - 9, "CRC-16"), (flac.parse(streams[3]).frames + 3, "CRC-8")):
        cut = bytearray(streams[3])
        cut[place] ^= 1
        with pytest.raises(ValueError, match=message):
            flac.decode([bytes(cut)])


# ---- 3: exact dedup


def test_exact_dedup(spark, odd, empty):
    def brute(rows):
        low = lambda t: (t or "").encode().lower()
        groups = defaultdict(list)
        for i, t in rows:
            groups[low(t)].append(i)
        out = []
        for i, t in rows:
            g = groups[low(t)]
            keep = max((x for x in g if x is not None), default=None)
            out.append((i, keep, len(g), i == keep, hashlib.sha256(low(t)).hexdigest()))
        return sorted(out, key=str)

    rng = random.Random(1)
    many = [(i, rng.choice(["A b", "a B", "c", "É", "é", ""]) if i % 3 else "hot") for i in range(400)]
    for rows in (ODD, many):
        got = [tuple(r) for r in dedup.judge(make(spark, rows)).collect()]
        assert sorted(got, key=str) == brute(rows)
    assert dedup.judge(empty).count() == 0
    assert sorted(r["doc_id"] for r in dedup.deduplicate(make(spark, [(1, "x"), (2, "X"), (3, "y")])).collect()) == [2, 3]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    log = str(tmp_path / "log")
    dedup.digests(dedup.located(make(spark, [(1, "a"), (2, "b")]))).write.parquet(log)
    stream = lambda: spark.readStream.schema(spark.read.parquet(log).schema).parquet(log)
    dedup.run_stream(stream(), str(tmp_path / "s"))
    dedup.digests(dedup.located(make(spark, [(9, "A"), (3, "c")]))).write.mode("append").parquet(log)
    state = dedup.run_stream(stream(), str(tmp_path / "s"))
    assert sorted((r["keep"]["doc_id"], r["n"]) for r in state.collect()) == [(2, 1), (3, 1), (9, 2)]


# ---- 6: n-gram join


def brute_classes(rows, t):
    def shingles(x):
        w = (x or "").encode().lower().split()
        return frozenset(zip(*(w[j:] for j in range(t.words)), strict=False)) if len(w) >= t.words else frozenset([tuple(w)] if w else [])

    s = {i: shingles(x) for i, x in rows}
    comp = {i: i for i in s}

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if s[a] and s[b] and t.linked(len(s[a] & s[b]), len(s[a]), len(s[b])):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {(i, len(s[i]), find(i)) for i in s}


@pytest.mark.parametrize("seed,t", [(0, simjoin.Threshold()), (1, simjoin.Threshold(5, 80, 100))])
def test_classes_equal_brute_force(spark, seed, t):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    passage = [word() for _ in range(40)]
    rows, base = [], []
    for i in range(170):
        if base and rng.random() < 0.55:
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            w += [word() for _ in range(rng.randint(0, 2))]
        else:
            w = [word() for _ in range(rng.choice([1, 3, 5, 9, 20, 60, 150]))] + (passage if rng.random() < 0.4 else [])
            base.append(w)
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, " \n "), (502, "Abc"), (503, "aBC")]
    got = {tuple(r) for r in simjoin.classes(make(spark, rows), t).collect()}
    assert got == brute_classes(rows, t)


def test_classes_of_odd_rows(spark, odd, empty):
    assert simjoin.classes(odd).count() == len(ODD)
    assert simjoin.classes(empty).count() == 0
    assert sorted(r["doc_id"] for r in simjoin.keep_one(make(spark, [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, "z")])).collect()) == [1, 3]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.9])
def test_linked_sets_share_a_signature(share):
    """The guarantee itself, for every allocation: sets at the threshold always meet."""
    t, rng = simjoin.Threshold(), np.random.default_rng(int(share * 10))
    made = simjoin.Signatures(t, np.sort(rng.integers(0, 1 << 62, 50).astype(np.uint64)), share)
    for n in [*range(1, 40), 60, 130, 400]:
        for _ in range(6):
            a = rng.integers(0, 1 << 62, n).astype(np.uint64)
            out = int(rng.integers(0, n // 6 + 1))
            b = np.r_[a[out:], rng.integers(0, 1 << 62, int(rng.integers(0, n // 6 + 1))).astype(np.uint64)]
            a, b = np.unique(a), np.unique(b)
            if len(b) and t.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert len(np.intersect1d(made.of(a), made.of(b)))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 400 + i) for i in range(50)]
    want = {}
    adjacent = defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    for n in sorted(adjacent):
        if n not in want:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = n
                    todo += adjacent[x]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


# ---- 5: sharding


def test_sharding(spark, odd, empty, tmp_path):
    rng = random.Random(2)
    rows = [(i, "y" * rng.randint(0, 400)) for i in range(6000)]
    got = sharding.shard(make(spark, rows), shards=24, map_path=str(tmp_path / "map")).collect()
    load, places = defaultdict(int), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert len(got) == 6000 and set(load) == set(range(24))
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 24
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")).shards == 24
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(make(spark, rows[::-1]), shards=24).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    assert sharding.shard(odd).count() == len(ODD) and sharding.shard(empty).count() == 0


def test_rebalancing_moves_little():
    rng = random.Random(5)
    sizes = [rng.randint(1, 100) for _ in range(2000)]
    m = sharding.SlotMap.planned(sizes, 10)
    grown = m.rebalance(sizes, 11)
    moved = [k for k in range(2000) if m.owner[k] != grown.owner[k]]
    assert sum(sizes[k] for k in moved) < 1.3 * sum(sizes) / 11
    assert max(grown.loads(sizes)) < 1.05 * sum(sizes) / 11
    less = grown.rebalance(sizes, 9)
    assert set(less.owner) == set(range(9)) and less.version == 2
    assert all(a == b for k, (a, b) in enumerate(zip(grown.owner, less.owner, strict=True)) if k not in {e[1] for e in less.edits if e[0] == 2})


# ---- 7: mixing


def water(budget, nodes):
    """Shares of (w, cap) nodes by repeated redistribution."""
    out, open_ = [0.0] * len(nodes), set(range(len(nodes)))
    while open_:
        left = budget - sum(out[i] for i in range(len(nodes)) if i not in open_)
        w = sum(nodes[i][0] for i in open_)
        full = [i for i in open_ if w > 0 and left * nodes[i][0] / w >= nodes[i][1]]
        if not full:
            for i in open_:
                out[i] = left * nodes[i][0] / w if w > 0 else 0.0
            return out
        for i in full:
            out[i] = nodes[i][1]
            open_.remove(i)
    return out


def test_mixing(spark, empty):
    rng = random.Random(6)
    rows = [(i, "t" * rng.randint(1, 200) if i % 50 else None, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "s3"])) for i in range(3000)]
    docs = make(spark, rows)
    plan = mixing.Plan([("lang", F.col("lang")), ("source", F.col("source"))], {"fr": 0.8, "en": 0.15}, total=0.7, epochs=2, bits=3)
    got = mixing.mix(docs, plan).collect()
    size = lambda t: max(1, -(-len(t or "") // 4))
    leaf = defaultdict(int)
    for _, t, lang, s in rows:
        leaf[lang or "?", s] += size(t)
    total = sum(leaf.values())
    langs = ["fr", "en", "?"]
    top = water(0.7 * total, [(w, 2 * sum(v for (a, _), v in leaf.items() if a == x)) for x, w in zip(langs, (0.8, 0.15, 0.05), strict=True)])
    taken, seen = defaultdict(int), defaultdict(set)
    for r in got:
        taken[r["_path"]] += r["_tokens"]
        assert (r["doc_id"], r["_epoch"]) not in seen[r["_path"]]
        seen[r["_path"]].add((r["doc_id"], r["_epoch"]))
    for x, b in zip(langs, top, strict=True):
        own = sorted(s for (a, s) in leaf if a == x)
        for s, want in zip(own, water(b, [(1 / len(own), 2 * leaf[x, s]) for s in own]), strict=True):
            assert -1 <= taken[f"{x}/{s}"] - want <= 51  # less than a document over
    firsts = defaultdict(set)
    for r in got:
        firsts[r["_path"], r["_epoch"]].add(r["doc_id"])
    for (p, e), ids in firsts.items():
        if e == 1:
            assert ids <= firsts[p, 0] and len(firsts[p, 0]) == sum(1 for r in rows if f"{r[2] or '?'}/{r[3]}" == p)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, plan).collect()))
    assert mixing.mix(empty, plan).count() == 0
    assert mixing.mix(make(spark, [(1, "a"), (1, "a"), (None, None)]), plan).count() >= 1


# ---- 2: URL filter


def test_url_rules(spark):
    urls = [
        ("http://a.com/x", "com/", "allow"), ("https://EXAMPLE.com/en/1?q", "example.com/en/", "block"), ("https://www.example.com/en/1", "www.example.com/en/", "allow"),
        ("http://xexample.com/en/1", "com/", "allow"), ("http://n.net/es/", "net/es/", "block"), ("http://n.net/EN/", None, None), ("http://b.com", None, None),
        ("no scheme", None, None), (None, None, None), ("http://b.com?x=/y", None, None), ("x://c.net/fr/#t", "net/fr/", "block"),
    ]
    pages = spark.createDataFrame([(i, u[0], None, "clash") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"], r["host"], r["path"]) for r in urlfilter.judge(pages, RULES).collect()}
    for i, (_, rule, verdict) in enumerate(urls):
        assert got[i][0] == rule and (verdict is None or got[i][1] == verdict)
    assert got[1][2:] == ("example.com", "/en/1") and got[9][2:] == ("b.com", "") and got[8][2:] == ("", "")
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0


def test_distrust_flows_back_along_links(spark):
    link = lambda *h: "".join(f'<a href="http://{x}/p">' for x in h)
    rows = [(i, f"http://bad.net/es/{i}", link()) for i in range(20)] + [(100, "http://feeder.org/1", link("bad.net", "bad.net")), (101, "http://clean.org/1", link("good.com")), (102, "http://good.com/1", link("clean.org")), (103, "http://bad.net/en/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, RULES).collect()}
    assert got[100] == "block" and got[101] == "allow" and got[102] == "allow" and got[103] == "block"
    few = urlfilter.Settings(broadcast_rows=0, salts=3)
    assert {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, RULES, few).collect()} == got
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {r[0]: r[4] for r in con.execute(urlfilter.oracle(RULES)).fetchall()} == got


# ---- 1 and 8: classifiers


def speech(rng, lang, n):
    parts = {"en": ["the", "and", "thing", "er", "wh", "ou"], "de": ["der", "und", "ung", "sch", "ei", "lich"], "fr": ["le", "des", "eau", "ou", "ment", "é"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark, odd, empty):
    rng = random.Random(8)
    rows = [(i, speech(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(["en", "de", "fr"], k=900))]
    got = langid.identify(make(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    truth = {i: lang for i, _, lang in rows}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    model = langid.train([t for _, t, _ in rows], [lang for _, _, lang in rows])
    odd_got = {r["doc_id"]: r["lang_pred"] for r in langid.apply(odd, model).collect()}
    assert odd_got[1] == odd_got[2] == odd_got[3] == "und" and odd_got[8] != "und"
    assert langid.identify(empty).count() == 0
    assert [r["lang_pred"] for r in langid.identify(make(spark, [(1, "abc", None)])).collect()] == ["und"]


def test_toxicity(spark, odd, empty):
    rng = random.Random(9)
    bad = ["idiot", "clown", "scum"]
    rows, marks = [], []
    for i in range(1400):
        w = speech(rng, rng.choice(["en", "de"]), rng.randint(5, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", ","])
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "en"))
        marks.append((i, 1, int(toxic) if i % 9 else None))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs = make(spark, rows)
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.apply(docs, model).collect()}
    held = [(m[0], m[0] % 4 == 0) for m in marks if zlib.crc32(str(m[0]).encode()) % 4 == 2]
    assert np.mean([got[i] == int(t) for i, t in held]) > 0.95
    kept = toxicity.apply(docs, model, docs.columns).where("predicted = 0").select(*[c for c in docs.columns if c != "score"])
    assert kept.count() == sum(v == 0 for v in got.values())
    assert toxicity.apply(odd, model).count() == len(ODD)
    assert toxicity.apply(empty, toxicity.fit(empty, labels)).count() == 0
    assert {r["score"] for r in toxicity.apply(odd, toxicity.fit(odd, labels.where("false"))).collect()} == {0.0}
