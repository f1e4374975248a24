import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm import simhash as simhash_module
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import Balls, bucket_plan, drop_near_duplicates, near_duplicates, near_links, similar_documents, simhash


def plain_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return 0
    parts = [" ".join(found[i : i + 4]) for i in range(len(found) - 3)] or [" ".join(found)]
    hashes = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Smallest member reachable, by brute force."""
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if near(a, b) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_fingerprint_matches_definition():
    for text in ["", " \x0b", "One", "A b C d", "É Ü x\x1cy z q w e", "the same the same the same the same", "k " * 500]:
        assert simhash(text) == plain_fingerprint(text)


def test_matches_brute_force(docs, corpus):
    got = near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    prints = {}
    for k, text, *_ in corpus:
        if k is not None:
            prints[k] = simhash(text or "")
    ids = sorted(prints)
    root = groups(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and len(r["fingerprint"]) == 16
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", root[r["doc_id"]])


def test_links_reach_every_distance_up_to_the_radius(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {}
    for d in range(1, 8):
        for _ in range(20):
            x = int(rng.integers(0, 2**63))
            y = x ^ sum(1 << int(b) for b in rng.choice(63, d, replace=False))
            rows += [(x,), (y,)]
            truth[min(x, y), max(x, y)] = d
    for radius in (2, 4):
        links = near_links(spark.createDataFrame(rows, "fp long"), len(rows), radius).distinct().collect()
        found = {(r["a"], r["b"]) for r in links}
        assert {p for p, d in truth.items() if d <= radius} == {p for p in found if p in truth}


def test_bucket_plan_is_bounded_at_any_size():
    for radius, masks in ((2, 65), (4, 2081)):
        for n in (0, 1, 10**5, 10**7, 10**8, 10**9):
            bits, sub_bits = bucket_plan(n, radius)
            balls = Balls(radius, bits, 0)
            assert n * len(balls.steps) / 2**bits <= 4_000_000 and n * masks / 2**bits <= 64_000_000
            assert n * masks / 2 ** (bits + sub_bits) <= 1_000_000
    assert len(Balls(4, bucket_plan(10**9, 4)[0], 0).steps) < 150  # copies of a fingerprint that are sent


def test_crowded_blocks_give_the_same_links(monkeypatch):
    """A block of very many variants is taken in parts by their hash."""
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)[:, None] ^ np.array([0, 1, 6, 1 << 40], dtype=np.uint64)).ravel()
    whole = Balls(4, 1, 0).links(fps, 0, 4)
    monkeypatch.setattr(simhash_module, "BLOCK_VARIANTS", 5000)
    assert len(whole) >= 300 and (Balls(4, 1, 0).links(fps, 0, 4) == whole).all()


def test_buckets_are_linear():
    balls = Balls(4, 5, 3)
    x = np.random.default_rng(2).integers(0, 2**64, 200, dtype=np.uint64)
    assert (balls.place(x[:100] ^ x[100:]) == (balls.place(x[:100]) ^ balls.place(x[100:]))).all()
    assert len(balls.masks) == 1 + 64 + 64 * 63 // 2
    with pytest.raises(ValueError):
        Balls(3, 5, 3)


def shingle_set(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_documents_are_what_they_say(spark, docs, corpus, words):
    import random

    rng, rows = random.Random(12), []
    for k in range(60):  # families: an original and copies with a few words changed
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randint(60, 250))]
        rows.append((1000 + 10 * k, " ".join(base)))
        for c in range(1, 4):
            w = list(base)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
            rows.append((1000 + 10 * k + c, " ".join(w)))
    texts = {k: t for k, t, *_ in corpus if k is not None} | dict(rows)
    sets = {k: shingle_set(t) for k, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(every).collect()}
    root = groups(sorted(texts), near)
    assert all(root[k] == root[got[k]] for k in texts)  # nothing is grouped that isn't linked
    linked = [k for k in texts if root[k] != k]
    assert len(linked) > 150 and sum(got[k] != k for k in linked) >= 0.97 * len(linked)
    assert {got[k] for k in range(240, 280)} <= set(range(5)) and got[None] is None
    assert len({got[k] for k in (320, 321, 322)}) == 1


def test_similar_documents_finds_block_edits(spark):
    """Blocks put in or cut off, at 0.80 to 0.85: every pair is found, and its words may be new or the text's own."""
    import random

    rng, rows, pairs = random.Random(31), [], []
    for size in (40, 100, 300):
        for k in range(12):
            base = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for n in range(1, size):
                block = [f"new{k}-{i}" if k % 2 else rng.choice(base) for i in range(n)]
                other = base[:-n] if k % 3 == 0 else base + block if k % 3 == 1 or size < 100 else base[: size // 2] + block + base[size // 2 :]
                a, b = shingle_set(" ".join(base)), shingle_set(" ".join(other))
                if not 0.8 <= len(a & b) / len(a | b):
                    break
                best = other
            a, b = shingle_set(" ".join(base)), shingle_set(" ".join(best))
            assert 0.8 <= len(a & b) / len(a | b) <= 0.85
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(best))]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: a for a, b in pairs for k in (a, b)}


def test_similar_documents_looks_past_a_failed_head(spark):
    """Text 1 has the words of 2 in another order and links to neither 2 nor 3, which link to each other; a chain links over its middle only."""
    import random

    rng = random.Random(32)
    base = [f"w{k % 120}" for k in rng.sample(range(500), 500)]
    other, swapped = rng.sample(base, 500), list(base)
    swapped[100], swapped[101] = swapped[101], swapped[100]
    chain = [[f"c{k}" for k in range(20 * n, 20 * n + 220)] for n in range(4)]
    rows = dict(enumerate(" ".join(w) for w in (other, base, swapped, *chain)))
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3}


def test_similar_documents_of_one_crowded_shingle(spark):
    """Many families that share a long passage: heads alone can't link them, and none is left out or linked by the passage."""
    import random

    rng, rows = random.Random(33), {}
    passage = [f"p{k}" for k in range(60)]
    for k in range(40):
        own = [f"f{k}-{i}" for i in range(20 + k % 5)]
        for c in range(5):
            w = passage + own
            w[rng.randrange(60)] = f"e{k}-{c}"
            rows[10 * k + c] = " ".join(w)
    sets = {k: shingle_set(t) for k, t in rows.items()}
    root = groups(sorted(rows), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == root and len(set(root.values())) > 20


def test_one_document_of_each_group_stays(docs, corpus):
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    components = {r["doc_id"]: r["component_id"] for r in similar_documents(docs).collect() if r["doc_id"] is not None}
    assert sorted(i for i in ids if i is not None) == sorted(set(components.values()))
    assert ids.count(None) == 2


def test_texts_of_one_id_are_told_apart(spark):
    a, b, c = ("a b c d e f g h", "i j k l m n o p", "q r s t u v w x")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, a), (4, None), (4, "")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, "_id long, text string"), id_col="_id").collect()
    kept = [tuple(r) for r in kept]
    assert sorted((k, t) for k, t in kept if k in (1, 2, 3)) == [(1, a), (1, b), (3, c)]
    assert kept.count((None, a)) == 1 and len([k for k, _ in kept if k == 4]) == 1


def test_long_and_short_texts(spark):
    long = " ".join(f"w{k % 9973}" for k in range(300_000))
    rows = [(1, long), (2, long + " more"), (3, "one two"), (4, "One TWO"), (5, "one two three")]
    got = {r["doc_id"]: r["component_id"] for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_empty_and_clashing_columns(spark, no_docs):
    assert near_duplicates(no_docs).count() == 0
    assert drop_near_duplicates(no_docs).count() == similar_documents(no_docs).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e", 3, 4, 5, 6), (2, "a b c d e", 5, 6, 7, 8)], "doc_id long, text string, fp long, component_id long, _id long, ROW_KEY long")
    assert {r["component_id"] for r in near_duplicates(odd).collect()} == {1}
    assert [tuple(r) for r in drop_near_duplicates(odd).collect()] == [(1, "a b c d e", 3, 4, 5, 6)]


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(149, 148), (7, 7), (200, 199), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)} | {199: 199, 200: 199}
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """Members of a large component are sent to the other blocks alone; links are those of all pairs."""
    monkeypatch.setattr(simhash_module, "BLOCK", 8)
    rng = np.random.default_rng(8)
    sets, rows = {}, []
    for g, (large, few) in enumerate([(60, 5), (0, 20), (40, 0)]):
        base = [rng.integers(0, 2**60, 40) for _ in range(5)]
        for k in range(large + few):
            node = 1000 * g + k
            sets[node] = np.unique(np.concatenate([base[k % 5][: 40 - k % 3], rng.integers(0, 2**60, 1 + k % 2)])).tolist()
            rows.append((g, node, len(sets[node]), g * 1000 if k < large else node))
    df = spark.createDataFrame(rows, "g long, node long, size int, c long")
    dealt = simhash_module.dealt_blocks(df).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in dealt} == {0: 60 + 5 * 9, 1: 20 * 3}
    got = simhash_module.blocked_links(df, spark.createDataFrame(list(sets.items()), "node long, s array<long>"), 0.8).collect()
    reach = {r[3]: r[3] for r in rows}

    def root(c):
        return c if reach[c] == c else root(reach[c])

    def joined(pairs):
        reach.update({c: c for c in reach})
        for a, b in pairs:
            low, high = sorted((root(a), root(b)))
            reach[high] = low
        return {c: root(c) for c in reach}

    common = lambda a, b: len(set(a) & set(b))
    want = [(x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and common(sets[x[1]], sets[y[1]]) >= 0.8 * (x[2] + y[2] - common(sets[x[1]], sets[y[1]]))]
    assert joined(map(tuple, got)) == joined(want) and len(set(reach.values())) < len(reach)


def test_a_text_goes_to_one_head(spark):
    pairs = [(1, 9, 50), (2, 9, 10), (2, 9, 10), (3, 8, 5), (4, 8, 7)]
    got = simhash_module.one_head_each(spark.createDataFrame(pairs, "a long, b long, weight long")).collect()
    assert sorted(map(tuple, got)) == [(2, 9), (4, 8)]


def test_texts_of_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    """With a list too large to broadcast, only rows that the bitmap doesn't rule out are; the rows are those of the plain join."""
    docs = spark.range(3000).selectExpr("IF(id % 50 = 0, NULL, id) AS doc_id", "concat('t', id) AS text")
    gone = spark.range(0, 3000, 7).selectExpr("id AS i", "xxhash64(concat('t', id)) AS k")
    match = (F.col("doc_id") == F.col("i")) & (F.xxhash64("text") == F.col("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = sorted(map(str, docs.join(gone, match, "left_anti").collect()))
        for most in (30, 19):
            monkeypatch.setattr(simhash_module, "BITMAP_BITS", most)
            kept = simhash_module.without(docs, gone, "i", "k", F.col("doc_id"), F.xxhash64("text"), match)
            plan = kept._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, kept.collect())) == want
            assert plan.count("SortMergeJoin") == 1 and ("Union" in plan) == (most == 30)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
