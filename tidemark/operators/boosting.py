"""Boosted trees of gradient steps on all rows, for all folds at once.

Rows are dealt to tasks, in blocks of one fold each, and stay with Spark as codes of two bytes. Each level of a tree is one job:
tasks add up gradients by node and bin for every fold that a row teaches, and the driver, which sees these sums alone, picks
the splits. Cuts are exact quantiles of all rows, found by counting how many rows lie up to a value. Gradients are whole
multiples of a power of two, so that sums are exact in any order: trees don't depend on how rows are dealt.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and of a task.
BLOCK, PART = 1 << 16, 1 << 20
#: Bits that a pass over the rows settles of each quantile.
BITS = 4


def keys_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers that stand in the order of the doubles, NaN last."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(2**63)


def doubles_of(keys: np.ndarray) -> np.ndarray:
    bits = (keys ^ np.uint64(2**63)).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)


def blocks(rows: DataFrame, names: Sequence[str], label: str, parts: int) -> RDD:
    """(fold, labels, a line of values for each column) of up to BLOCK rows each, in `parts` partitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def out(k: int) -> pa.RecordBatch:
            x = np.ascontiguousarray(np.concatenate(held.pop(k)).T)
            return pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "y": pa.array([x[0].astype(np.uint8).tobytes()], pa.binary()), "x": pa.array([x[1:].tobytes()], pa.binary())})

        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]], axis=1)
            fold = b.column(0).to_numpy()
            for k in np.unique(fold).tolist():
                own = x[fold == k]
                for first in range(0, len(own), BLOCK):
                    held.setdefault(k, []).append(own[first : first + BLOCK])
                    if sum(map(len, held[k])) >= BLOCK:
                        yield out(k)
        for k in sorted(held):
            yield out(k)

    src = rows.repartition(parts, "transaction_id").select(F.col("fold").cast("int").alias("fold"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), *[F.col(c).cast("double").alias(c) for c in names])
    d = len(names)
    return src.mapInArrow(work, "fold int, y binary, x binary").rdd.map(lambda r: (r[0], np.frombuffer(r[1], np.uint8), np.frombuffer(r[2], float).reshape(d, -1)))


def order_statistics(ordered: RDD, ranks: np.ndarray) -> np.ndarray:
    """The values with these ranks (fold, column, rank) among the rows outside each fold. ordered: (fold, sorted keys by column)."""
    n_folds, d, _ = ranks.shape
    low, digits = np.zeros(ranks.shape, np.uint64), np.arange(1, 1 << BITS, dtype=np.uint64)
    for shift in range(64 - BITS, -1, -BITS):
        asked = ordered.context.broadcast((low[..., None] + (digits << np.uint64(shift)) - np.uint64(1)).reshape(n_folds, d, -1))

        def upto(part: Iterator[tuple[int, np.ndarray]], asked=asked) -> Iterator[np.ndarray]:
            counts = np.zeros(asked.value.shape, np.int64)
            for fold, keys in part:
                others = [k for k in range(n_folds) if k != fold]
                for c in range(d):
                    counts[others, c] += np.searchsorted(keys[c], asked.value[others, c], side="right")
            yield counts

        counts = sum(ordered.mapPartitions(upto).collect()).reshape(*ranks.shape, -1)  # a number a probe and task
        low += (counts <= ranks[..., None]).sum(axis=-1).astype(np.uint64) << np.uint64(shift)
        asked.unpersist()
    return doubles_of(low)


def quantiles(ordered: RDD, sizes: Sequence[int], d: int, bins: int) -> list[list[np.ndarray]]:
    """By fold and column the distinct quantiles, bins - 1 at most, of the rows outside the fold, between ranks as numpy has them."""
    at = np.stack([(max(n, 1) - 1) * (np.arange(1, bins) / bins) for n in sizes])[:, None, :].repeat(d, axis=1)
    below = np.floor(at).astype(np.int64)
    above = np.minimum(below + 1, np.maximum(np.array(sizes), 1)[:, None, None] - 1)
    found = order_statistics(ordered, np.concatenate([below, above], axis=2))
    a, b = found[..., : bins - 1], found[..., bins - 1 :]
    t, step = at - below, b - a
    value = np.where(t >= 0.5, b - step * (1 - t), a + step * t)
    return [[np.unique(value[k, c]) if n else np.zeros(0) for c in range(d)] for k, n in enumerate(sizes)]


@dataclass
class Round:
    """One tree of each fold: by node the column (-1: all to the left), the largest code that goes left, the same as a bin of the
    fold's own cuts, and the leaves' steps."""

    column: np.ndarray
    upto: np.ndarray
    bin: np.ndarray
    step: np.ndarray

    def node(self, k: int, codes: np.ndarray, levels: int) -> np.ndarray:
        n = codes.shape[1]
        node, flat, place = np.zeros(n, np.int64), codes.ravel(), np.arange(n)
        for level in range(levels):
            at = 2**level - 1 + node
            column = self.column[k].take(at)
            node = 2 * node + ((flat.take(column * n + place) > self.upto[k].take(at)) & (column >= 0))
        return node


@dataclass
class Fit:
    """What tasks need for a level: the cuts' places among all folds' cuts, classes, and the trees so far."""

    name: str
    teach: list[int]
    places: list[list[np.ndarray]]
    width: list[int]
    weight: np.ndarray
    start: np.ndarray
    scale: np.ndarray
    bins: int
    depth: int
    rate: float
    rounds: list[Round] = field(default_factory=list)

    def file(self, part: int, done: int) -> str:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]
        return os.path.join(folder, f"boosting-{self.name}-{part}-{done}")

    def sums(self, part: int, held: Iterator[tuple[int, np.ndarray, np.ndarray]], done: int, tree: Round, level: int, asked: np.ndarray) -> Iterator[np.ndarray]:
        """Gradients and curvatures by fold, parent, column and bin of the nodes asked for, one a parent at most, at a level of the tree
        after `done` whole ones. Margins are kept in the task's local folder from round to round; where they aren't, all trees are
        walked again."""
        parents = 2 ** max(0, level - 1)
        out = np.zeros((len(self.start), 2, parents, len(self.width), self.bins))
        raw = {k: [np.zeros((2, parents, w)) for w in self.width] for k in self.teach}
        have = next((s for s in (done, done - 1) if s > 0 and os.path.exists(self.file(part, s))), 0)
        new = f"{self.file(part, done)}-{uuid.uuid4().hex}" if done > have else None
        with open(self.file(part, have) if have else os.devnull, "rb") as old, open(new or os.devnull, "wb") as kept:
            for fold, y, codes in held:
                n = len(y)
                margin = np.fromfile(old, float, len(self.start) * n).reshape(-1, n) if have else np.repeat(self.start[:, None], n, 1)
                for r in self.rounds[have:done]:
                    for k in self.teach:
                        if k != fold:
                            margin[k] += self.rate * r.step[k][r.node(k, codes, self.depth)]
                if new:
                    margin.tofile(kept)
                for k in self.teach:
                    if k == fold:
                        continue
                    node = tree.node(k, codes, level)
                    at = np.flatnonzero(asked[k].take(node)) if level else slice(None)
                    label, parent = y[at], node[at] >> 1
                    p, w = 1 / (1 + np.exp(-margin[k][at])), self.weight[k][label] * self.scale[k]
                    g, h = np.rint(w * (label - p)), np.rint(w * p * (1 - p))
                    for c, width in enumerate(self.width):
                        key = parent * width + (codes[c].take(at) if level else codes[c])
                        for v, into in zip((g, h), raw[k][c], strict=True):
                            into += np.bincount(key, v, into.size).reshape(into.shape)
        if new:
            os.replace(new, self.file(part, done))
            self.forget(part, [have] if have else [])
        for k in self.teach:
            for c, place in enumerate(self.places[k]):
                out[k, :, :, c, : len(place) + 1] = np.add.reduceat(raw[k][c], np.concatenate([[0], place + 1]), axis=2)
        yield out

    def forget(self, part: int, rounds: Sequence[int]) -> None:
        for s in rounds:
            with suppress(FileNotFoundError):
                os.remove(self.file(part, s))


def grown(level_sums: Callable[[int, Round, int, np.ndarray], np.ndarray], fit: Fit, rounds: int, ridge: float) -> None:
    """Adds rounds to the fit, level by level, from sums over all rows. Of two nodes under one, the lighter one's rows are added up,
    and the other's sums are what remains, exactly."""
    folds, d, bins = len(fit.start), len(fit.width), fit.bins
    for done in range(rounds):
        tree = Round(np.full((folds, 2**fit.depth - 1), -1), np.zeros((folds, 2**fit.depth - 1), np.int64), np.zeros((folds, 2**fit.depth - 1), np.int64), np.zeros((folds, 2**fit.depth)))
        asked = np.ones((folds, 1), bool)
        for level in range(fit.depth):
            width, first = 2**level, 2**level - 1
            sums = level_sums(done, tree, level, asked)
            if level:
                right = asked.reshape(folds, -1, 2)[..., 1][:, None, :, None, None]
                rest = above - sums
                sums = np.stack([np.where(right, rest, sums), np.where(right, sums, rest)], axis=3).reshape(folds, 2, width, d, bins)
                idle = ~asked.reshape(folds, -1, 2).any(axis=2)  # not split: all rows are on the left
                for k, i in np.argwhere(idle).tolist():
                    sums[k, :, 2 * i], sums[k, :, 2 * i + 1] = above[k, :, i], 0
            above, asked = sums, np.zeros((folds, 2 * width), bool)
            for k in fit.teach:
                left = sums[k].cumsum(axis=3) / fit.scale[k]
                (gl, hl), (ga, ha) = left, left[:, :, :1, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain = np.where((hl > 1e-6) & (ha - hl > 1e-6), gain, 0).reshape(width, -1)
                best = gain.argmax(axis=1)
                split = gain[np.arange(width), best] > 1e-9
                column, cut = np.where(split, best // bins, -1), best % bins
                tree.column[k, first : first + width], tree.bin[k, first : first + width] = column, cut
                tree.upto[k, first : first + width] = [fit.places[k][c][b] if c >= 0 else 0 for c, b in zip(column, cut, strict=True)]
                part, whole = left.reshape(2, width, d * bins)[:, np.arange(width), best], left[:, :, 0, -1]
                asked[k, 2 * np.arange(width) + (2 * part[1] > whole[1])] = split
                if level == fit.depth - 1:
                    # The leaves' sums are those on both sides of the last splits.
                    g, h = (np.stack([np.where(split, p, a), np.where(split, a - p, 0)], axis=1).ravel() for p, a in zip(part, whole, strict=True))
                    tree.step[k] = g / (h + ridge)
        fit.rounds.append(tree)


def boosted(rows: DataFrame, names: Sequence[str], label: str, n_folds: int, rounds: int = 200, rate: float = 0.1, depth: int = 4, bins: int = 64, ridge: float = 1.0) -> dict[int, tuple | float]:
    """For each fold (cuts by column, margin at the start, trees as (column, bin, step)) of all rows of the other folds, both classes
    weighted alike; the share of positives where there are not both classes. rows: transaction_id, fold, the columns, the label."""
    sc, d = rows.sparkSession.sparkContext, len(names)
    y = F.coalesce(F.col(label).cast("int"), F.lit(0))
    own = {r["fold"]: (r["n"], r["pos"]) for r in rows.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).collect()}
    n, pos = np.array([[sum(own[j][i] for j in own if j != k) for k in range(n_folds)] for i in (0, 1)], dtype=np.int64).reshape(2, -1)
    teach = [k for k in range(n_folds) if 0 < pos[k] < n[k]]
    out: dict[int, tuple | float] = {k: float(pos[k]) / max(1, int(n[k])) for k in range(n_folds)}
    if not teach:
        return out
    weight = np.stack([n / 2 / np.maximum(1, n - pos), n / 2 / np.maximum(1, pos)], axis=1)
    share = np.clip(weight[:, 1] * pos / np.maximum(1e-12, weight[:, 1] * pos + weight[:, 0] * (n - pos)), 1e-6, 1 - 1e-6)
    rows_in_all = sum(v[0] for v in own.values())
    parts = max(min(sc.defaultParallelism, -(-rows_in_all // BLOCK)), -(-rows_in_all // PART))
    base = blocks(rows, names, label, parts)
    ordered = base.map(lambda b: (b[0], np.sort(keys_of(b[2]), axis=1))).persist(StorageLevel.MEMORY_AND_DISK)
    cuts = quantiles(ordered, n.tolist(), d, bins)
    ordered.unpersist()
    every = [np.unique(np.concatenate([cuts[k][c] for k in teach])) for c in range(d)]
    places = [[np.searchsorted(every[c], cuts[k][c]) for c in range(d)] for k in range(n_folds)]
    coded = base.map(lambda b: (b[0], b[1], np.stack([np.searchsorted(e, x).astype(np.uint16) for e, x in zip(every, b[2], strict=True)]))).persist(StorageLevel.MEMORY_AND_DISK)
    # The weights of all rows add up to their number, and sums stay below 2^52.
    fit = Fit(uuid.uuid4().hex, teach, places, [len(e) + 1 for e in every], weight, np.log(share / (1 - share)), 2.0 ** (51 - np.ceil(np.log2(n + 1))), bins, depth, rate)

    def level_sums(done: int, tree: Round, level: int, asked: np.ndarray) -> np.ndarray:
        return sum(coded.mapPartitionsWithIndex(lambda i, part: fit.sums(i, part, done, tree, level, asked)).collect())  # sums by task

    try:
        grown(level_sums, fit, rounds, ridge)
    finally:
        coded.mapPartitionsWithIndex(lambda i, part: fit.forget(i, range(max(0, len(fit.rounds) - 1), len(fit.rounds) + 1)) or iter([])).collect()
        coded.unpersist()
    for k in teach:
        out[k] = cuts[k], float(fit.start[k]), [(r.column[k], r.bin[k], r.step[k]) for r in fit.rounds]
    return out
