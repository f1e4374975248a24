import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations as module
from tidemark.llm.collocations import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, words long, times long, n long"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(rows, least, top=2000, longest=5):
    count, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    count.setdefault(lang, Counter())[tuple(w[i : i + size])] += 1
    out = []
    for lang, f in count.items():
        frequent = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in frequent.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(found[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["The", "of", "and", "ÉTÉ", "b b", "日本", "x", "New", "york", "city", "a\x0b", "…"]
    rows = []
    for k in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(x + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for x in w)
        rows.append((text + rng.choice(["", "new york city of the", "x x x x x x x", "the\tTHE the of"]), ["en", "de", None, ""][k % 4 if k % 3 else 0]))
    rows += [(None, "en"), ("", None), (" \t\n.,", "en"), ("alone", "fr"), ("x " * 30_000, "xx")]
    return rows + rows[:40] + [rows[0]] * 100


def frame(spark, texts):
    return spark.createDataFrame([(k % 9 or None, t, g, "clash", 1, 2, 3) for k, (t, g) in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(("least", "top", "bits"), [(3, 2000, 26), (40, 20, 26), (5, 50, 15)])
def test_against_counting_everything(spark, texts, least, top, bits):
    """A bitmap of few bits lets more through, and nothing changes."""
    assert rows_of(collocations(frame(spark, texts), least=least, top=top, bits=bits)) == plain(texts, least, top)


def test_small_holds_and_spills(spark, texts, monkeypatch):
    monkeypatch.setattr(module, "HELD", 100)
    assert rows_of(collocations(frame(spark, texts), least=10)) == plain(texts, 10)



def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_products(spark):
    from pyspark.sql import functions as F

    wide = lambda c: F.lit(c).cast("decimal(17,0)")
    a, n, left, right = 9_876_543_210_123, 99_999_999_999_977, 10_000_000_000_019, 9_999_999_999_991
    row = spark.range(1).select((F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n)).alias("over"), (wide(left) * wide(right)).alias("under")).selectExpr("over div under AS score").first()
    assert row.score == 1000 * a * n // (left * right)
