"""Boosted trees on all rows, against the same trees grown in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, models


def table(spark, n=3000):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((n, len(models.INPUTS))), 2)
    x[:, 3], x[:, 5] = rng.integers(0, 2, n), 7.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(n) > 1.6).astype(int)
    rows = [(f"T{i:05d}", int(i % 5), int(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "transaction_id string, fold int, is_suspicious int, " + ", ".join(f"{c} double" for c in models.INPUTS))
    return df, x, y, np.arange(n) % 5


def plain(x, y, rounds):
    weight = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    return models.BoostedTrees(x, y.astype(float), weight, rounds=rounds)


@pytest.mark.parametrize("block", [1 << 16, 100])
def test_trees_are_those_of_all_rows(spark, monkeypatch, block):
    """Cuts, splits and scores, whether rows are one block in one task or many blocks in several."""
    monkeypatch.setattr(boosting, "BLOCK", block)
    df, x, y, fold = table(spark)
    found = boosting.boosted(df, models.INPUTS, "is_suspicious", 5, rounds=6)
    for k in range(5):
        want = plain(x[fold != k], y[fold != k], 6)
        assert all(np.allclose(a, b, rtol=1e-12, atol=0) for a, b in zip(found[k][0], want.cuts, strict=True))
        for (column, cut, value), (c, b, v) in zip(found[k][2], want.trees, strict=True):
            assert column.tolist() == c.tolist() and cut[column >= 0].tolist() == b[c >= 0].tolist() and value == pytest.approx(v, abs=1e-6)
        assert models.BoostedTrees.of(*found[k]).score(x) == pytest.approx(want.score(x), abs=1e-6)


def test_every_row_teaches(spark, monkeypatch):
    """One changed label among rows that a bounded sample leaves out changes what the others' folds learn."""
    monkeypatch.setattr(boosting.boosted, "__defaults__", (2, *boosting.boosted.__defaults__[1:]))
    monkeypatch.setattr(models, "SAMPLE", 50, raising=False)
    df, *_ = table(spark, 1000)
    score = lambda rows: {r["transaction_id"]: r["score"] for r in models.cross_validated(rows, "gbt").collect()}
    before = score(df)
    for flipped in ("T00001", "T00577", "T00998"):
        after = score(df.withColumn("is_suspicious", F.when(F.col("transaction_id") == flipped, 1 - F.col("is_suspicious")).otherwise(F.col("is_suspicious"))))
        changed = {int(i[1:]) % 5 for i in before if before[i] != after[i]}
        assert changed == set(range(5)) - {int(flipped[1:]) % 5}


def test_margins_that_are_lost_are_made_again(spark, monkeypatch):
    df, *_ = table(spark, 600)
    kept = boosting.boosted(df, models.INPUTS, "is_suspicious", 5, rounds=4)
    monkeypatch.setattr(boosting.Fit, "file", lambda self, part, done: f"/tmp/no-such-folder-{self.name}/{part}-{done}")
    monkeypatch.setattr(boosting.os, "replace", lambda a, b: None)
    monkeypatch.setattr(boosting, "open", lambda path, mode: open("/dev/null", mode), raising=False)
    lost = boosting.boosted(df, models.INPUTS, "is_suspicious", 5, rounds=4)
    for k in range(5):
        for a, b in zip(kept[k][2], lost[k][2], strict=True):
            assert all(np.array_equal(p, q) for p, q in zip(a, b, strict=True))


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal(500) * 1e9, np.repeat([-3.5, 0.0, -0.0, 7e-300], 60), [np.inf, -np.inf]])
    fold = np.arange(len(x)) % 3
    parts = spark.sparkContext.parallelize([(k, np.sort(boosting.keys_of(x[(fold == k)][None]), axis=1)) for k in range(3)], 2)
    got = boosting.quantiles(parts, [int((fold != k).sum()) for k in range(3)], 1, 64)
    for k in range(3):
        want = np.unique(np.quantile(x[fold != k], np.arange(1, 64) / 64))
        assert got[k][0].tolist() == want.tolist()


def test_folds_without_both_classes_give_shares(spark, monkeypatch):
    monkeypatch.setattr(boosting.boosted, "__defaults__", (2, *boosting.boosted.__defaults__[1:]))
    df, *_ = table(spark, 50)
    one = df.withColumn("is_suspicious", (F.col("fold") == 2).cast("int") * (F.col("transaction_id") == "T00002").cast("int"))
    got = {r["fold"]: r["score"] for r in models.cross_validated(one.where("fold < 3"), "gbt", 3).select("fold", "score").distinct().collect() if r["fold"] == 2}
    assert got == {2: 0.0} and models.cross_validated(df.where("false"), "gbt").count() == 0
