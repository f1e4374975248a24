import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm.divergence import differ, divergence, share

SCHEMA = "doc_id long, text string, lang string, source string, p long, term string, gid int, n string"


def plain(rows, least=10, top=10):
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in count if g == lang]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        own = {s: shares(count[lang, s]) for s in sources}
        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(own[s][t], own[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(own[s][t], whole[t]), t.encode()) for t in kept if count[lang, s][t] and own[s][t] > whole[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    common = ["the", "Of", "été", "ÉTÉ", "日本", "don't", "a1b", "x"]
    rows = []
    for k in range(900):
        s = rng.randrange(13) if k % 3 else 0
        lang = ["en", "de", None, ""][k % 4 if k % 5 else 0]
        words = [rng.choice(common) for _ in range(rng.randint(0, 12))] + [f"rare{chr(97 + rng.randrange(3) + s)}{chr(97 + rng.randrange(4))}" for _ in range(rng.randint(0, 6))]
        rows.append((" ".join(words), lang, None if s == 12 else f"s{s}"))
    rows += [(None, "en", "silent"), ("", "en", ""), ("one two", "only", "one"), ("12 34", "none", "a"), (None, "none", "b"), ("é", "none", "日")]
    return rows + rows[:30] + [(" ".join(["the"] * 50_000), "en", "s1")]


def frame(spark, rows):
    return spark.createDataFrame([(k % 7 or None, *r, 5, "clash", 1, "n") for k, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("least", "block", "shard"), [(10, 256, 2048), (3, 4, 5), (1, 1, 1)])
def test_against_the_plain_sum(spark, rows, least, block, shard):
    df = divergence(frame(spark, rows), least_docs=least, block=block, shard=shard)
    assert df.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert sorted(map(tuple, df.collect())) == plain(rows, least)


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_64_bits(spark):
    n, total, kept = 123_456_789_012_345, 987_654_321_098_765, 100_000_007
    row = spark.createDataFrame([(n, total, kept), (0, 0, 0)], "n long, total long, kept long").select(share("n", "total", "kept").alias("p")).collect()
    assert [r.p for r in row] == [1 + 10**9 * (n + 2) // (total + 2 * kept), 1]


def test_largest_difference():
    assert differ(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18 // (10**9 + 2)]
