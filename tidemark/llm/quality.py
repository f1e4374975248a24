"""A quality classifier of hashed word and character n-gram vectors, averaged per document, with a softmax on top.

Words, immediate repeats of a word, and the character 3- to 5-grams that don't run over white space are hashed into one
table of vectors. A document is the mean of its features' vectors. Training is plain stochastic gradient descent in numpy on a bounded sample of labelled
documents. As everything before the softmax is linear, a trained model scores by one number per table row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .mixing import hash60

MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(ODD), -1, 2**64))
NGRAMS = (3, 4, 5)
#: Bytes featurised at a time; longer texts go in several blocks, cut at a space. Of all features only a repeat of a word
#: over the cut is lost, and n-grams at the cut where so many bytes hold no space.
BLOCK = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, table rows) of the words and character n-grams of UTF-8 bytes, one pair per kind of feature."""
    shift, n = np.uint64(64 - bits), len(data)
    if not n:
        return
    space = SPACES[data]
    wide = data.astype(np.uint64)
    start = ~space & np.concatenate(([True], space[:-1]))
    # Words: differences of a running polynomial hash, brought back to the word's own start.
    power, back = np.full(n, ODD), np.full(n, INVERSE)
    power[0] = back[0] = 1
    power, back = np.cumprod(power), np.cumprod(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * power)))
    end = ~space & np.concatenate((space[1:], [True]))
    a, b = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    words = ((total[b] - total[a]) * back[a] * MIX) >> shift
    yield a, words
    # A word that repeats the one before it is a feature of its own, whichever word it is.
    again = a[1:][words[1:] == words[:-1]]
    yield again, np.full(len(again), MIX >> shift)
    # n-grams may begin or end with white space, the border of a word, but not hold it inside.
    gaps = np.concatenate(([0], np.cumsum(space)))
    for k in NGRAMS:
        m = n - k + 1
        if m <= 0:
            break
        packed = wide[:m].copy()
        for i in range(1, k):
            packed |= wide[i : i + m] << np.uint64(8 * i)
        at = np.nonzero(gaps[k - 1 : k - 1 + m] == gaps[1 : 1 + m])[0]
        yield at, ((packed[at] + np.uint64(k)) * MIX ^ (packed[at] >> np.uint64(29))) * MIX >> shift


def blocks(text: str) -> Iterator[np.ndarray]:
    data = text.encode()
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data) and (cut := data.rfind(b" ", at + 1, end)) > at:
            yield np.frombuffer(data, np.uint8, cut + 1 - at, at)
            at = cut  # the space ends one block and begins the next, so no n-gram is lost
        else:
            yield np.frombuffer(data, np.uint8, end - at, at)
            at = end


def bag(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct table rows of a text and how often each occurs, as shares of all."""
    rows = [r for block in blocks(text) for _, r in features(block, bits)]
    rows, n = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint64), return_counts=True)
    return rows.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


@dataclass
class QualityModel:
    """Log-odds of label 1 per table row, and the bias."""

    weights: np.ndarray
    bias: float
    bits: int

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 of each whole text."""
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            total, n = 0.0, 0
            for block in blocks(text):
                for at, rows in features(block, self.bits):
                    total += float(self.weights[rows.astype(np.int64)].sum(dtype=np.float64))
                    n += len(at)
            out[k] = total / n if n else 0.0
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -500, 500)))


def train(texts: list[str], labels: list[int], *, bits: int = 18, dim: int = 16, epochs: int = 6, rate: float = 0.05, seed: int = 11) -> QualityModel:
    """Stochastic gradient descent over single documents, the rate falling linearly to zero. One class or none: its share."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    share = (float((y == 1).sum()) + 1) / (len(y) + 2)
    if len(set(labels)) < 2:
        return QualityModel(np.zeros(1 << bits, np.float32), float(np.log(share / (1 - share))), bits)
    bags = [bag(t, bits) for t in texts]
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    out, bias = np.zeros((dim, 2)), np.log(np.array([1 - share, share]))
    # Vectors of rare features would hardly move under their share of the mean: their step is scaled by the bag's size.
    step, steps = 0, epochs * len(bags)
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, part = bags[i]
            lr, step = rate * (1 - step / steps), step + 1
            hidden = part @ table[rows] if len(rows) else np.zeros(dim)
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1.0
            back = out @ p
            out -= lr * np.outer(hidden, p) * dim
            bias -= lr * 0.1 * p
            if len(rows):
                table[rows] -= (lr * dim) * np.outer(part / np.sqrt((part * part).sum()), back)
    return QualityModel((table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def training_rows(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 4000, max_chars: int = 16_000_000) -> DataFrame:
    """Labelled texts (id, text, label) in the order of the hash of their id: at most max_docs, and those that still fit
    into max_chars together.

    Null labels and ids are left out; an id labelled more than once has its labels' rounded mean; a row that repeats counts
    once. The label side of the join is cut to max_docs rows first, so broadcasting it is safe at any size, and lengths
    are looked at before any text is gathered.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("label"))
    few = materialize(known.withColumn("h", hash60(F.col("id"))).orderBy("h", "id").limit(max_docs), "quality-few")
    texts = docs.select(F.col(id_col).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    both = texts.join(F.broadcast(few), F.col("did") == F.col("id"))
    sizes = both.select("h", "id", "key", F.length("text").alias("n")).distinct().orderBy("h", "id", "key").limit(max_docs).collect()
    taken, chars = [], 0
    for r in sizes:
        if chars + r["n"] <= max_chars:
            taken.append((r["id"], r["key"]))
            chars += r["n"]
    chosen = docs.sparkSession.createDataFrame(taken, T.StructType([T.StructField("tid", few.schema["id"].dataType), T.StructField("tkey", T.LongType())]))
    picked = both.join(F.broadcast(chosen), (F.col("id") == F.col("tid")) & (F.col("key") == F.col("tkey")))
    return picked.select("h", "id", "key", "text", "label").distinct().orderBy("h", "id", "key").select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, *, max_docs: int = 4000, max_chars: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> QualityModel:
    """Trains on the driver on at most max_docs documents of max_chars characters together, whatever the tables' size."""
    rows = training_rows(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_docs=max_docs, max_chars=max_chars).collect()
    return train([r["text"] for r in rows], [r["label"] for r in rows], **options)


def scorer(model: QualityModel, docs: DataFrame):
    """A column function: text -> probability of label 1; null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(held.value.scores([t or "" for t in texts]), dtype="float64")

    return scored


def score(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs's columns plus score_col (0 to 1), which replaces a column of that name. Whole texts are scored, whatever their
    length; empty and null texts score as the bias does. Empty table: empty result. No shuffle; rows, repeats included, keep their other columns."""
    return docs.withColumn(score_col, scorer(model, docs)(F.col(text_col)))


def keep_good(docs: DataFrame, model: QualityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score at least threshold, with the columns of docs."""
    return docs.where(scorer(model, docs)(F.col(text_col)) >= threshold)
