import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ann import Shard, nearest
from tidemark.llm.embed_dedup import cells_of, code_axes, codes_of, embedding_duplicates, near_codes, spherical_kmeans, unit

SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0] * 7 + [float("nan")], 1), (903, [1.0] * 7 + [float("inf")], 1), (904, [1.0] * 7 + [None], 1), (905, [1.0] * 8, None), (906, [1.0] * 5, 1), (907, [], 1)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    out = [(k, v.tolist(), k % 2) for k, v in enumerate(x)]
    out += [(k, (x[k % 40] + 0.03 * rng.standard_normal(8)).tolist(), k % 2) for k in range(400, 600)]
    out += [(k, x[3].tolist(), 1) for k in range(600, 700)]
    return [(k, np.float32(v).tolist(), y) for k, v, y in out] + ODD


def test_near_duplicates_match_brute_force(spark, rows):
    got = {r["vec_id"]: r for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    live = [(k, np.array(v, float), y) for k, v, y in rows if k < 900 or k == 906]
    links = {k: set() for k, *_ in live}
    for a, x, la in live:
        for b, y, lb in live:
            if a != b and la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a].add(b)
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            todo = [b for a in todo for b in links[a] if b not in seen and not seen.add(b)]
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(links[k]), min(seen), k == min(seen))
    for k in (900, 901, 902, 903, 904, 905, 907):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True)
    assert len(got) == len(rows)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (6, [0.0, 1.0], 1)], SCHEMA)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(df).collect())
    assert got == [(False, 5, 1, 5, True), (False, 5, 1, 5, True), (False, 6, 0, 6, True), (True, 0, 0, None, True)]
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_guests_cover_links_across_cells():
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((300, 3)))
    row, cell, own = cells_of(x, spherical_kmeans(x, 12), np.sqrt(2 - 2 * 0.98))
    cells = {k: set(cell[row == k]) for k in range(300)}
    home = dict(zip(row[own], cell[own], strict=True))
    for a in range(300):
        for b in range(300):
            if x[a] @ x[b] >= 0.98:
                assert home[a] in cells[b]


def test_codes_never_keep_a_near_guest_out():
    rng = np.random.default_rng(9)
    x = unit(rng.standard_normal((500, 40)))
    y = unit(x + 0.03 * rng.standard_normal(x.shape) * rng.random((500, 1)))
    axes, reach = code_axes(np.concatenate([x, y])), np.sqrt(2 - 2 * 0.98)
    a, b = codes_of(x, axes), codes_of(y, axes)
    linked = (x * y).sum(axis=1) >= 0.98
    assert linked.sum() > 100 and all(near_codes(a[k : k + 1], b[k : k + 1], reach)[0] for k in np.nonzero(linked)[0])
    assert near_codes(a, b[:50][::-1], reach)[50:].mean() < 0.05 and not near_codes(a, b[:0], reach).any()


def test_many_blocks_and_cells_agree_with_one(spark, rows, monkeypatch):
    from tidemark.llm import embed_dedup

    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, embedding_duplicates(df).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "CODE_BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "CELL_ROOT", 2)
    assert sorted(map(str, embedding_duplicates(df).collect())) == whole


def test_nearest_recall_order_and_odd_rows(spark, rows, monkeypatch):
    from tidemark.llm import ann

    monkeypatch.setattr(ann, "SHARD_ROWS", 200)
    monkeypatch.setattr(ann, "FIRST_BLOCK", 0.05)
    monkeypatch.setattr(ann, "MAX_SHARD", 200)
    odd = spark.createDataFrame([(*r, 1, 2.0) for r in rows], SCHEMA + ", id int, shard double")
    got = nearest(odd, F.col("vec_id") % 20 == 0).collect()
    live = {k: np.array(v, float) for k, v, _ in rows if k < 900 or k == 905}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {k for k in live if k % 20 == 0}
    hit = total = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        keys = [(-r["score"], r["vec_id"]) for r in found]
        assert keys == sorted(keys) and all(r["vec_id"] != q and abs(r["score"] - live[q] @ live[r["vec_id"]]) < 1e-9 for r in found)
        best = sorted((-(live[q] @ v), k) for k, v in live.items() if k != q)[:20]
        hit += len({k for _, k in best} & {r["vec_id"] for r in found})
        total += 20
    assert hit / total >= 0.9


def test_few_vectors_are_verified():
    """What the collision threshold lets through, of vectors without any structure."""
    rng = np.random.default_rng(7)
    x = unit(rng.standard_normal((8000, 64)))
    queries, own = x[::100], np.arange(0, 8000, 100)
    best = np.argsort(-(queries @ x.T), axis=1)[:, 1:21]
    shard = Shard(x, np.arange(8000), 1.0)
    bound = np.sort(queries @ unit(rng.standard_normal((40_000, 64))).T, axis=1)[:, -20]  # as if 40,000 more had been searched
    for least in (None, bound):
        shard.verified = 0
        found = shard.search(queries, own, 20, shard.reach(20), least)
        goal = [{int(j) for j in b if least is None or x[j] @ q >= bound[i]} for i, (b, q) in enumerate(zip(best, queries, strict=True))]
        hit = sum(len(g & set(shard.ids[at].tolist())) for g, (at, _) in zip(goal, found, strict=True))
        assert hit >= 0.9 * sum(map(len, goal))
        assert shard.verified / (len(queries) * 8000) < (0.25 if least is None else 0.1)


def test_repeated_ids_ask_once(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (0, [0.0, 1.0], 1), (1, [1.0, 2.0], 1), (1, [3.0, 0.5], 1)], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 1, 0.5)]


def test_nearest_with_few_candidates_and_ties(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1)], SCHEMA)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 1, -1.0)]


def test_a_shard_above_16_bits():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((70_000, 8))
    shard = Shard(x, np.arange(70_000), float(np.linalg.norm(x, axis=1).max()))
    hit = 0
    for q, (at, score) in zip(x[:20], shard.search(x[:20], np.arange(20), 20, shard.reach(20), None), strict=True):
        products = x @ q
        assert np.allclose(products[at], score)
        hit += len(set(at.tolist()) & set(np.argsort(-products)[:21].tolist()))
    assert hit >= 0.9 * 400


def test_one_id_and_one_vector_on_many_rows(spark, monkeypatch):
    """They are dealt to all shards."""
    from tidemark.llm import ann

    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "MAX_SHARD", 100)
    rng = np.random.default_rng(7)
    vectors = [[float(v) for v in rng.standard_normal(6)] for _ in range(300)]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(5, vectors[5])] * 300 + [(5, vectors[6])] * 100
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=20).collect()
    x = np.array([v for _, v in rows])
    ids = np.array([k for k, _ in rows])
    hit = total = 0
    for q in range(0, 300, 50):
        best = sorted((-float(x[j] @ x[q]), int(ids[j])) for j in range(len(ids)) if ids[j] != q)[:20]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in own] == list(range(1, 21))
        scores = sorted((-r["score"] for r in got if r["query_id"] == q))
        hit += sum(s <= best[-1][0] + 1e-9 for s in scores)
        total += 20
    assert hit >= 0.9 * total
