"""Columns of the user's own come through operators unchanged, whatever they are called."""

import random

from tilespark.llm import dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, Score double, predicted int, `a.b` string, _metadata string, _AT string"


def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        words = [rng.choice(["rotten", "vile", "nasty"] if bad and k % 3 == 0 else ["calm", "river", "stone", "light"]) for k in range(30)]
        rows.append((i, " ".join(words), "en", -7.0 - i, 99 + i, f"ab{i}", f"m{i}", f"at{i}"))
    return rows, spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")


def test_rejection_keeps_columns(spark):
    rows, df, labels = docs(spark)
    got = toxicity.reject(df, labels)
    assert got.columns == df.columns and got.schema == df.schema
    kept = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert 200 < len(kept) < 400 and all(kept[r[0]] == r for r in rows if r[0] in kept)
    named = toxicity.apply(df, toxicity.fit(df, labels), ["a.b", "Score", "doc_id"])
    assert named.columns == ["a.b", "doc_id", "score", "predicted"] and named.where("score < 0").count() == 0


def test_dedup_keeps_columns(spark, tmp_path):
    rows, df, _ = docs(spark)
    df.union(df).repartition(3).write.parquet(str(tmp_path / "d"))
    for again in (df.union(df), spark.read.parquet(str(tmp_path / "d"))):
        got = dedup.deduplicate(again)
        assert got.columns == df.columns and {tuple(r) for r in got.collect()} == set(rows) and got.count() == len(rows)
