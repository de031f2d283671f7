"""Dedup stages on tables whose ids repeat or are null."""

from collections import Counter

import pytest

from tilespark.llm import dedup, simjoin

LONG = "one two three four five six seven eight"
ROWS = [(5, "x", "a"), (9, "X", "b"), (5, "y", "c"), (7, "z", "d"), (7, "z", "d"), (None, "x", "e"), (None, "n", "f"), (None, "n", "f"), (1, None, "g"), (1, "", "g"), (2, "", "h"), (3, LONG, "i"), (3, LONG.upper(), "i"), (4, LONG + " nine", "j"), (3, "quite other words stand here", "k")]
SCHEMA = "doc_id long, text string, keep_id string"


@pytest.fixture(params=["in memory", "file"])
def docs(request, spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    if request.param == "file":
        df.repartition(3).write.parquet(f"{tmp_path}/d")
        df = spark.read.parquet(f"{tmp_path}/d")
    return df


def key(r):
    return (r[0], (r[1] or "").lower())


def test_one_row_of_each_text_stays(docs):
    best: dict = {}
    for i, text in map(key, ROWS):
        best[text] = max(best.get(text, -1), -1 if i is None else i)
    got = dedup.deduplicate(docs)
    assert got.columns == docs.columns
    assert Counter(map(key, got.collect())) == Counter((None if i < 0 else i, t) for t, i in best.items())
    assert all(tuple(r) in ROWS for r in got.collect())


def test_one_row_of_each_component_stays(docs):
    got = simjoin.keep_one(docs, simjoin.Threshold(words=4, num=80, den=100))
    want = [(5, "x"), (5, "y"), (7, "z"), (None, "n"), (1, ""), (2, ""), (3, LONG), (3, "quite other words stand here")]
    assert got.columns == docs.columns and Counter(map(key, got.collect())) == Counter(want)
