"""Anomaly models, cross-validated by entity. Sums, the forest's samples, the outlier factors' neighbours and the boosted trees'
gradients are taken from all rows; folds are fitted side by side in tasks, rows scored on the executors."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FEATURES
from ..session import materialize
from . import boosting
from .neighbours import local_outlier_factors

INPUTS = (*FEATURES, "amount_cents")


class Sums:
    """Count, sums and products of columns around given values: they add up, and take away, exactly as rows do."""

    def __init__(self, mid: np.ndarray, n: float, s: np.ndarray, products: np.ndarray):
        self.mid, self.n, self.s, self.products = mid, n, s, products

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.mid, self.n + other.n, self.s + other.s, self.products + other.products)

    def moments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(mean, population sigma with 0 as 1, sample covariance, rows)."""
        d = len(self.mid)
        if not self.n:
            return np.zeros(d), np.ones(d), np.eye(d), 0
        centred = self.products - np.outer(self.s, self.s) / self.n
        sigma = np.sqrt(np.maximum(np.diag(centred) / self.n, 0))
        return self.mid + self.s / self.n, np.where(sigma > 0, sigma, 1.0), centred / max(1, self.n - 1), int(self.n)


def sums_by(df: DataFrame, key: Column, names=INPUTS) -> dict[object, Sums]:
    """Sums for each value of key, which must have few, in one pass; around values near the means, which keeps the
    covariance stable."""
    rough = df.agg(*[F.avg(c) for c in names]).first()
    mid = np.array([float(x or 0.0) for x in rough])
    shifted = [F.col(c).cast("double") - float(m) for c, m in zip(names, mid, strict=True)]
    cells = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    out, d = {}, len(names)
    for row in df.groupBy(key.alias("_key")).agg(F.count(F.lit(1)), *[F.sum(x) for x in shifted], *[F.sum(shifted[i] * shifted[j]) for i, j in cells]).collect():
        products = np.zeros((d, d))
        for (i, j), x in zip(cells, row[d + 2 :], strict=True):
            products[i, j] = products[j, i] = x
        out[row[0]] = Sums(mid, row[1], np.array(row[2 : d + 2], dtype=float), products)
    return out


def total(parts: list[Sums], d: int) -> Sums:
    out = Sums(np.zeros(d), 0, np.zeros(d), np.zeros((d, d)))
    for p in parts:
        out = p + out
    return out


def moments(df: DataFrame, names=INPUTS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    return total(list(sums_by(df, F.lit(0), names).values()), len(names)).moments()


class IsolationForest:
    """Random trees over samples; the shorter a row's mean path, the more it stands apart."""

    def __init__(self, x: np.ndarray, trees: int = 300, size: int = 4096, seed: int = 3):
        rng, size = np.random.default_rng(seed), min(size, len(x))
        self.norm = self.expected(np.array([size]))[0]
        self.trees = [self.grown(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)]

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: int) -> IsolationForest:
        """A forest of trees that were each grown on `size` rows."""
        out = cls.__new__(cls)
        out.norm, out.trees = cls.expected(np.array([size]))[0], trees
        return out

    @classmethod
    def grown(cls, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        """(column or -1, cut, first child, path added at the end) of each node, grown level by level for all nodes at once."""
        column, cut, child, extra = [], [], [], []
        depth = max(1, int(np.ceil(np.log2(max(2, len(x))))))
        node, first, width = np.zeros(len(x), np.int64), 0, 1
        for level in range(depth + 1):
            order = np.argsort(node, kind="stable")
            x, node = x[order], node[order]
            count = np.bincount(node, minlength=width)
            held = np.nonzero(count)[0]
            starts = np.searchsorted(node, held)
            low, high = np.zeros((width, x.shape[1])), np.zeros((width, x.shape[1]))
            if len(held):
                low[held], high[held] = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            open_ = high > low
            inner = open_.any(axis=1) & (level < depth)
            chosen = np.where(open_, rng.random(open_.shape), -1).argmax(axis=1)
            k = np.arange(width)
            at = rng.uniform(low[k, chosen], high[k, chosen])
            to = first + width + 2 * (np.cumsum(inner) - 1)
            column.append(np.where(inner, chosen, -1).astype(np.int8))
            cut.append(at)
            child.append(np.where(inner, to, 0).astype(np.int32))
            extra.append(np.where(inner, 1.0, cls.expected(count)))
            if not inner.any():
                break
            live = inner[node]
            x, node = x[live], node[live]
            first, width, node = first + width, 2 * int(inner.sum()), to[node] - first - width + (x[np.arange(len(x)), chosen[node]] >= at[node])
        return tuple(np.concatenate(v) for v in (column, cut, child, extra))

    @staticmethod
    def expected(n: np.ndarray) -> np.ndarray:
        """Mean path length of an unsuccessful search in a tree of n rows."""
        n = np.asarray(n, dtype=float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    @staticmethod
    def stepped(column: np.ndarray, cut: np.ndarray, child: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(column, cut, next node, whole path, levels) of a tree in which leaves lead to themselves: all rows take as many
        steps, and the path is known from where they end."""
        inner = np.flatnonzero(column >= 0)
        up = np.full(len(column), -1, np.int64)
        up[child[inner]] = up[child[inner] + 1] = inner
        path, above, levels = extra.copy(), up, 0
        while (above >= 0).any():
            path += np.where(above >= 0, extra[above], 0)
            above, levels = np.where(above >= 0, up[above], -1), levels + 1
        leaf = column < 0
        # Nothing is at least NaN.
        return np.where(leaf, 0, column).astype(np.int64), np.where(leaf, np.nan, cut), np.where(leaf, np.arange(len(column)), child).astype(np.int64), path, levels

    def score(self, x: np.ndarray) -> np.ndarray:
        paths, flat, first = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        if not hasattr(self, "steps"):
            self.steps = [self.stepped(*t) for t in self.trees]
        for column, cut, to, path, levels in self.steps:
            node = np.zeros(len(x), np.int64)
            for _ in range(levels):
                node = to.take(node) + (flat.take(first + column.take(node)) >= cut.take(node))
            paths += path.take(node)
        return 2.0 ** (-paths / max(1, len(self.trees)) / max(self.norm, 1e-9))


class BoostedTrees:
    """Trees of gradient steps for a weighted logistic loss, over columns cut into bins at quantiles; `boosting` grows them."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 200, rate: float = 0.1, depth: int = 4, bins: int = 64, ridge: float = 1.0):
        self.cuts = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
        self.rate, self.depth, self.trees = rate, depth, []
        codes, f = self.coded(x), np.zeros(len(x))
        columns = x.shape[1]
        flat = codes + np.arange(columns) * bins
        share = float(np.clip((weight * y).sum() / weight.sum(), 1e-6, 1 - 1e-6))
        self.start = float(np.log(share / (1 - share)))
        f += self.start
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, column, cut = np.zeros(len(x), np.int64), np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                key = (flat + (node * columns * bins)[:, None]).ravel()
                sums = [np.bincount(key, np.repeat(v, columns), width * columns * bins).reshape(width, columns, bins).cumsum(axis=2) for v in (g, h)]
                (gl, hl), (ga, ha) = sums, (v[:, :1, -1:] for v in sums)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain = np.where((hl > 1e-6) & (ha - hl > 1e-6), gain, 0).reshape(width, -1)
                best = gain.argmax(axis=1)
                split = gain[np.arange(width), best] > 1e-9
                column[first : first + width] = np.where(split, best // bins, -1)
                cut[first : first + width] = best % bins
                c = column[first + node]
                node = 2 * node + (codes[np.arange(len(x)), c] > cut[first + node]) * (c >= 0)
            value = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge)
            f += rate * value[node]
            self.trees.append((column, cut, value))

    @classmethod
    def of(cls, cuts: list[np.ndarray], start: float, trees: list[tuple[np.ndarray, ...]], rate: float = 0.1) -> BoostedTrees:
        """Trees that were grown elsewhere."""
        out = cls.__new__(cls)
        out.cuts, out.start, out.trees, out.rate, out.depth = cuts, start, trees, rate, int(np.log2(len(trees[0][2]))) if trees else 0
        return out

    def coded(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cuts, c) for cuts, c in zip(self.cuts, x.T, strict=True)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        codes, rows, f = self.coded(x), np.arange(len(x)), np.full(len(x), self.start)
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (codes[rows, column[at]] > cut[at]) * (column[at] >= 0)
            f += self.rate * value[node]
        return 1 / (1 + np.exp(-f))


class Scaled:
    """A model behind the training rows' mean and sigma."""

    def __init__(self, model, mean: np.ndarray, sigma: np.ndarray):
        self.model, self.mean, self.sigma = model, mean, sigma

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.model.score((x - self.mean) / self.sigma)


class Mahalanobis:
    """Squared distance from the mean under the inverse covariance, a small ridge added."""

    def __init__(self, covariance: np.ndarray, ridge: float = 1e-6):
        self.inverse = np.linalg.pinv(covariance + ridge * np.eye(len(covariance)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x, self.inverse, x)


class Share:
    """The share of positives, where there are not both classes to learn from."""

    def __init__(self, share: float):
        self.share = share

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> BoostedTrees | Share:
    return BoostedTrees(x, y, weight) if 0 < y.sum() < len(y) else Share(float((weight * y).sum() / max(1e-12, weight.sum())))


def tree_hashes(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A row's place in a tree's order, from its id's hash."""
    salt = np.random.SeedSequence([seed, tree]).generate_state(1, np.uint64)[0]
    h = (ids.view(np.uint64) ^ salt) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def forest_rows(rows: DataFrame, trees: int, share: float, seed: int) -> DataFrame:
    """(tree, h, fold, x): the rows of each tree's order up to a share of it, from one pass over all rows."""
    limit = np.uint64(min(share, 1.0) * float(2**64 - 2**11)) if share < 1 else np.uint64(2**64 - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for t in range(trees):
                h = tree_hashes(ids, t, seed)
                at = np.flatnonzero(h <= limit)
                if len(at):
                    some = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(t, pa.int32()), len(at)), pa.array(h[at].view(np.int64)), b.column(1).take(some), b.column(2).take(some)], ["tree", "h", "fold", "x"])

    src = rows.select(F.xxhash64("transaction_id").alias("id"), F.col("fold").cast("int").alias("fold"), F.array(*[F.col(c).cast("double") for c in INPUTS]).alias("x"))
    return src.mapInArrow(work, "tree int, h long, fold int, x array<double>")


def smallest(h: np.ndarray, fold: np.ndarray, leave: int, size: int) -> np.ndarray:
    """Places of the rows outside a fold that come first in a tree's order."""
    at = np.flatnonzero(fold != leave)
    return at[np.argsort(h[at].view(np.uint64), kind="stable")[:size]]


def isolation_forests(rows: DataFrame, n_folds: int, scales: dict, trees: int = 300, size: int = 4096, seed: int = 3) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
    """A scorer for each fold: every tree is grown on the `size` rows of the other folds that come first in its own order of all
    rows. Tasks pass on only rows below a hash that enough rows stay under; should one tree get too few, all try a larger one."""
    others = {k: scales[k][3] for k in range(n_folds)}
    n = sum(others.values()) / max(1, n_folds - 1) if n_folds > 1 else others.get(0, 0)
    wanted = size + 8 * size**0.5 + 64

    def grow(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        h, fold, x = table["h"].to_numpy(), table["fold"].to_numpy(), table["x"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        out = []
        for k in range(n_folds):
            at = smallest(h, fold, k, size)
            whole = len(at) == min(size, others[k])
            mean, sigma = scales[k][:2]
            out.append(pickle.dumps(IsolationForest.grown((x[at] - mean) / sigma, np.random.default_rng([seed, k, tree]))) if whole and len(at) else None if not whole else b"")
        return pa.table({"tree": pa.array([tree] * n_folds, pa.int32()), "fold": pa.array(range(n_folds), pa.int32()), "model": pa.array(out, pa.binary())})

    while True:
        share = wanted / max(1.0, min((m for m in others.values() if m), default=1))
        grown = forest_rows(rows, trees, share, seed).groupBy("tree").applyInArrow(grow, "tree int, fold int, model binary").collect() if n else []
        if all(r["model"] is not None for r in grown) and (len(grown) == trees * n_folds or share >= 1 or not n):
            break
        wanted *= 2
    by = {k: [pickle.loads(r["model"]) for r in sorted(grown, key=lambda r: r["tree"]) if r["fold"] == k and r["model"]] for k in range(n_folds)}
    return {k: Scaled(IsolationForest.of(by[k], min(size, others[k])) if by[k] else Share(0.0), *scales[k][:2]) for k in range(n_folds)}


def outlier_factors(rows: DataFrame, n_folds: int, scales: dict) -> DataFrame:
    """transaction_id, fold, score: the local outlier factor of each row among all rows of the other folds, exactly; 0 where there
    are none. Each fold is a setting of its own, in which its rows ask and all others are candidates."""
    scaled = lambda k: F.array(*[(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(INPUTS, *scales[k][:2], strict=True)])
    settings = F.array(*[F.struct(F.lit(k).alias("setting"), (F.col("fold") != k).alias("candidate"), scaled(k).alias("v")) for k in range(n_folds)])
    points = materialize(rows.select(F.col("transaction_id").alias("id"), F.explode(settings).alias("p")).select("p.setting", "id", "p.candidate", "p.v"), "points")
    found = local_outlier_factors(points).select(F.col("id").alias("transaction_id"), "factor")
    return rows.select("transaction_id", F.col("fold").cast("int").alias("fold")).join(found, "transaction_id", "left").select("transaction_id", "fold", F.coalesce("factor", F.lit(0.0)).alias("score"))


def boosted_trees(rows: DataFrame, n_folds: int) -> dict[int, Callable[[np.ndarray], np.ndarray]]:
    """A scorer for each fold, fitted on all rows of the others; bins don't change with a column's scale."""
    found = boosting.boosted(rows, INPUTS, "is_suspicious", n_folds)
    return {k: (Share(f) if isinstance(f, float) else BoostedTrees.of(*f)).score for k, f in found.items()}


def logistic_scores(train: DataFrame, test: DataFrame, scale: tuple, label: str) -> DataFrame:
    """transaction_id and score of test rows, by balanced logistic regression on all of train, which sees labels. Without
    both classes in train, the score is the share of positives."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n, pos = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(label), F.lit(0))).first()
    if not pos or pos == n:
        return test.select("transaction_id", F.lit(float(pos) / max(1, n)).alias("score"))
    mean, sigma = scale[:2]
    scaled = lambda df: df.select("transaction_id", *([F.col(label).cast("double").alias("label")] if label in df.columns else []), *[((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(INPUTS, mean, sigma, strict=True)])
    assemble = VectorAssembler(inputCols=list(INPUTS), outputCol="x")
    weighted = assemble.transform(scaled(train)).withColumn("w", F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
    out = LogisticRegression(featuresCol="x", weightCol="w", standardization=False, regParam=1.0 / n, maxIter=100).fit(weighted).transform(assemble.transform(scaled(test).drop("label")))
    return out.select("transaction_id", vector_to_array("probability")[1].alias("score"))


def supervised(train: DataFrame, test: DataFrame, kind: str, label: str = "is_suspicious") -> DataFrame:
    """transaction_id and <kind>_score of test rows, for kind logistic."""
    return logistic_scores(train, test, moments(train), label).withColumnRenamed("score", f"{kind}_score")


def score_folds(rows: DataFrame, models: dict[int, Callable[[np.ndarray], np.ndarray]], keep: Sequence[str] = ()) -> DataFrame:
    """transaction_id, fold, score and columns to keep: each row by its fold's model, in batches on the executors."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, fold, score = b[list(INPUTS)].to_numpy(dtype=float), b["fold"].to_numpy(), np.zeros(len(b))
            for k in np.unique(fold).tolist():
                score[fold == k] = held.value[k](x[fold == k])
            yield pd.DataFrame({"transaction_id": b["transaction_id"], "fold": fold.astype(np.int32), "score": score, **{c: b[c] for c in keep}})

    schema = T.StructType([T.StructField("transaction_id", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("score", T.DoubleType()), *[rows.schema[c] for c in keep]])
    return rows.select("transaction_id", F.col("fold").cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in INPUTS], *keep).mapInPandas(work, schema)


def cross_validated(rows: DataFrame, model: str, n_folds: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """transaction_id, fold, score: each row scored by a model fitted on the other folds. rows: INPUTS, transaction_id, fold,
    and is_suspicious for the models that see labels (logistic, gbt). All folds' means, sigmas and covariances come from one
    pass of sums; trees are boosted on all rows too. keep: columns of rows that go along with scores of gbt."""
    if model == "gbt":
        return score_folds(rows, boosted_trees(rows, n_folds), keep)
    own = sums_by(rows, F.col("fold"))
    scales = {k: total([v for j, v in own.items() if j != k], len(INPUTS)).moments() for k in range(n_folds)}
    if model == "logistic":
        out = None
        for k in range(n_folds):
            scored = logistic_scores(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), scales[k], "is_suspicious").select("transaction_id", F.lit(k).alias("fold"), "score")
            out = scored if out is None else out.unionByName(scored)
        return out
    if model == "mahalanobis":
        return score_folds(rows, {k: Scaled(Mahalanobis(c / np.outer(sigma, sigma)), mean, sigma) for k, (mean, sigma, c, _) in scales.items()})
    if model == "lof":
        return outlier_factors(rows, n_folds, scales)
    if model == "isolation_forest":
        return score_folds(rows, isolation_forests(rows, n_folds, scales))
    raise ValueError(f"no model {model}")
