"""Op 2: ranks settle, however long the way."""

import numpy as np

from tilespark.llm import urlfilter
from tilespark.llm.queries import RULES


def test_ranks_settle(spark):
    links = [(i + 1, i, 1.0) for i in range(20)] + [(30, 31, 2.0), (31, 30, 1.0), (30, 5, 1.0)]
    seeds = {0: (0.0, 200.0), 30: (10.0, 0.0), 7: (3.0, 1.0)}
    n, d = 32, 0.85
    w = np.zeros((n, n))
    for a, b, x in links:
        w[a, b] = x
    f, g = w / np.maximum(w.sum(1, keepdims=True), 1e-300), w / np.maximum(w.sum(0), 1e-300)
    t, u = (np.array([seeds.get(i, (0, 0))[k] for i in range(n)]) * (1 - d) for k in (0, 1))
    trust, distrust = np.linalg.solve(np.eye(n) - d * f.T, t), np.linalg.solve(np.eye(n) - d * g, u)
    got = urlfilter.spread(
        spark.createDataFrame([(f"h{i}", *v) for i, v in seeds.items()], "host string, trust double, distrust double"),
        spark.createDataFrame([(f"h{a}", f"h{b}", x) for a, b, x in links], "src string, dst string, w double"), urlfilter.Settings())
    found = {r["host"]: (r["trust"], r["distrust"]) for r in got.collect()}
    for i in range(n):
        assert np.allclose(found.get(f"h{i}", (0, 0)), (trust[i], distrust[i]), atol=1e-4), i


def test_distrust_reaches_far_hosts(spark):
    pages = [(i, f"http://h0.net/es/{i}", "") for i in range(200)]
    pages += [(1000 + k, f"http://h{k}.org/", f'<a href="http://h{k - 1}.{"net" if k == 1 else "org"}/">') for k in range(1, 15)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert [got[1000 + k] for k in (1, 8, 9, 14)] == ["block"] * 4


def test_plans_stay_of_one_size(spark, monkeypatch):
    """Without broadcasts each round is a plan of its own, however many rounds there are."""
    sizes = []
    stored = urlfilter.stored

    def spy(df, name, *more):
        if name == "host-ranks":
            sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        return stored(df, name, *more)

    monkeypatch.setattr(urlfilter, "stored", spy)
    pages = [(i, f"http://h0.net/es/{i}", "") for i in range(200)]
    pages += [(1000 + k, f"http://h{k}.org/", f'<a href="http://h{k - 1}.{"net" if k == 1 else "org"}/">') for k in range(1, 20)]
    urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, urlfilter.Settings(broadcast_rows=0, tolerance=1e-2)).count()
    assert len(sizes) >= 16 and len(set(sizes[1:])) == 1 and sizes[1] < 40
