"""Folds, and the models that take in all rows, against plain definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models, neighbours
from tidemark.operators.running import with_moments

POINTS = "setting int, id string, candidate boolean, v array<double>"


def points_of(x, setting=0, every=5):
    return [(setting, f"{i:05d}", i % every != setting, [float(z) for z in v]) for i, v in enumerate(x)]


def plain_near(rows, k):
    x, ids = np.array([r[3] for r in rows]), [r[1] for r in rows]
    cand = np.flatnonzero([r[2] for r in rows])
    out = {}
    for i, r in enumerate(rows):
        d = np.sqrt(((x[cand] - x[i]) ** 2).sum(axis=1))
        out[r[0], r[1]] = sorted((float(d[j]), ids[c]) for j, c in enumerate(cand) if c != i)[:k]
    return out


def plain_factors(rows, k):
    near = plain_near(rows, k)
    radius = {key: n[-1][0] for key, n in near.items()}
    density = {key: 1 / max(np.mean([max(d, radius[key[0], o]) for d, o in n]), 1e-12) for key, n in near.items()}
    return {(r[0], r[1]): np.mean([density[r[0], o] for _, o in near[r[0], r[1]]]) / density[r[0], r[1]] for r in rows if not r[2]}


def test_neighbours_are_the_plain_ones(spark, monkeypatch):
    """Clusters, far points, and eighty rows that are the same; cells and blocks of a few rows."""
    monkeypatch.setattr(neighbours, "CELL", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(2)
    rows = []
    for s in (0, 1):
        rows += points_of(np.concatenate([rng.standard_normal((250, 5)), rng.standard_normal((150, 5)) * 0.1 + 4, np.repeat(rng.standard_normal((1, 5)), 80, 0), rng.standard_normal((20, 5)) * 30]), s)
    got = {(r["setting"], r["id"]): [(n["d"], n["other"]) for n in r["near"]] for r in neighbours.neighbours(spark.createDataFrame(rows, POINTS), 10).collect()}
    assert got == plain_near(rows[:500], 10) | plain_near(rows[500:], 10)


def test_few_points_and_none(spark):
    rows = points_of(np.arange(4.0)[:, None], every=9)
    got = {r["id"]: [n["other"] for n in r["near"]] for r in neighbours.neighbours(spark.createDataFrame(rows, POINTS), 35).collect()}
    assert got["00001"] == ["00002", "00003"] and got["00000"] == ["00001", "00002", "00003"]
    none = spark.createDataFrame([], POINTS)
    assert neighbours.neighbours(none, 3).count() == neighbours.local_outlier_factors(none).count() == 0


def test_factors_of_five_thousand_rows(spark):
    rng = np.random.default_rng(3)
    rows = points_of(np.concatenate([rng.standard_normal((4000, 6)), rng.standard_normal((990, 6)) * 0.2 + 3, rng.uniform(-9, 9, (10, 6))]))
    want = plain_factors(rows, 35)
    got = {(r["setting"], r["id"]): r["factor"] for r in neighbours.local_outlier_factors(spark.createDataFrame(rows, POINTS), 35).collect()}
    assert set(got) == set(want) and all(got[key] == pytest.approx(want[key], rel=1e-9) for key in want)


def test_each_tree_takes_the_first_rows_of_its_own_order(spark):
    n = 900
    df = spark.range(n).select(F.concat(F.lit("TXN-"), F.col("id").cast("string")).alias("transaction_id"), (F.col("id") % 5).cast("int").alias("fold"), *[(F.col("id") * 1.0).alias(c) for c in models.INPUTS])
    ids = np.array([r[0] for r in df.select(F.xxhash64("transaction_id")).collect()])
    folds = np.arange(n) % 5
    by = {}
    for r in models.forest_rows(df, 7, 0.3, 3).collect():
        by.setdefault(r["tree"], []).append((r["h"], r["fold"], int(r["x"][0])))
    assert len(by) == 7
    for t, rows in by.items():
        h, fold, place = (np.array(v) for v in zip(*rows, strict=True))
        for leave in range(5):
            order = models.tree_hashes(ids, t, 3)
            want = [i for i in np.argsort(order, kind="stable").tolist() if folds[i] != leave][:100]
            assert place[models.smallest(h, fold, leave, 100)].tolist() == want
    assert len({tuple(sorted(p for _, _, p in rows)) for rows in by.values()}) == 7


def test_forests_retry_until_every_tree_is_full(spark):
    n = 400
    df = spark.range(n).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 5).cast("int").alias("fold"), *[(F.hash("id", F.lit(c)) % 1000 * 1.0).alias(c) for c in models.INPUTS])
    scales = {k: (np.zeros(len(models.INPUTS)), np.ones(len(models.INPUTS)), None, 320) for k in range(5)}
    made = models.isolation_forests(df, 5, scales, trees=4, size=300)
    assert all(len(m.model.trees) == 4 for m in made.values())
    x = np.zeros((3, len(models.INPUTS)))
    assert all(((0 < m(x)) & (m(x) < 1)).all() for m in made.values())
    assert models.isolation_forests(df.where("false"), 5, {k: (*scales[k][:3], 0) for k in scales}, trees=2)[0](x).tolist() == [0, 0, 0]


@pytest.mark.parametrize("bits", [1, 16])
def test_folds_are_even_within_classes(spark, bits):
    rows = [(f"E{k}", int(k % 7 == 0 and j == 1)) for k in range(213) for j in range(3)]
    df = spark.createDataFrame(rows, "entity_id string, is_suspicious int")
    got = {r["entity_id"]: r["fold"] for r in evaluation.folds(df, bits=bits).collect()}
    assert len(got) == 213 and got == {r["entity_id"]: r["fold"] for r in evaluation.folds(df).collect()}
    for positive in (True, False):
        sizes = np.bincount([f for e, f in got.items() if (int(e[1:]) % 7 == 0) == positive], minlength=5)
        assert sizes.max() - sizes.min() <= 1
    assert evaluation.folds(df.where("false")).count() == 0


def test_moments_merge_over_spans_without_losing_digits(spark):
    rng = np.random.default_rng(4)
    x = 1e9 + rng.standard_normal(200) * 1e-3
    df = spark.createDataFrame([("k" if i % 4 else "one", i, f"{i:04d}", float(v)) for i, v in enumerate(x)], "key string, t long, id string, x double")
    for span in (1, 7, 1000):
        for r in with_moments(df, ["key"], "t", span, "x", tie="id").collect():
            prior = np.array([v for i, v in enumerate(x) if i < r["t"] and ("k" if i % 4 else "one") == r["key"]])
            assert r["moments"]["n"] == len(prior)
            if len(prior) > 1:
                assert r["moments"]["m2"] == pytest.approx(((prior - prior.mean()) ** 2).sum(), rel=1e-3)


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Twenty copies of each vector, of both kinds: few places go into the search, and all points have their own neighbours."""
    x = np.random.default_rng(6).standard_normal((30, 3))
    rows = points_of(np.concatenate([x] * 20))
    searched, whole = [], neighbours.near_places
    monkeypatch.setattr(neighbours, "near_places", lambda points, k: searched.append(points.count()) or whole(points, k))
    got = {(r["setting"], r["id"]): [(n["d"], n["other"]) for n in r["near"]] for r in neighbours.neighbours(spark.createDataFrame(rows, POINTS), 25).collect()}
    assert searched == [30] and got == plain_near(rows, 25)


def test_places_of_enough_candidates_ask_no_other_group(spark, monkeypatch):
    """Sixty copies of a vector hold all neighbours themselves, but for the six vectors that are no candidates; with fewer copies no
    more is listed than is needed."""
    monkeypatch.setattr(neighbours, "CELL", 5)
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    x = np.random.default_rng(7).standard_normal((30, 3))
    kept, whole = {}, neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, name: kept.setdefault(name, []).append(whole(df, name)) or kept[name][-1])
    for copies, k in ((60, 10), (4, 10)):
        rows = points_of(np.concatenate([x] * copies))
        got = {(r["setting"], r["id"]): [(n["d"], n["other"]) for n in r["near"]] for r in neighbours.neighbours(spark.createDataFrame(rows, POINTS), k).collect()}
        assert got == plain_near(rows, k)
    asking = [df.select("id").distinct().count() for df in kept["near-asked"]]
    assert asking[0] <= 6 < asking[1]
    assert kept["near-first"][1].where(F.size("near") > 3).count() == 0
