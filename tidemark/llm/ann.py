"""Nearest neighbours by collision counting: single-projection hashes, query-centred windows, virtual rehashing.

Vectors are dealt into shards and queries into blocks; each pair of a shard and a block is one task. A shard keeps one
sorted array of values per random projection. Around a query's own value, a window in proportion to the search radius is
counted in every array; vectors that fall into enough windows are verified by their exact product. The radius grows,
which widens the same windows (virtual rehashing: nothing is hashed again), until it reaches the distance of the k-th best
product so far. A first shard's answers bound the radius in all others. The largest product becomes the smallest distance
by one more component that gives all vectors the same norm (Neyshabur and Srebro, 2015); the counting follows Huang et
al., 2015.

A vector at distance r falls into a window of half-width WIDTH * r with a chance of 0.866, one at 1.37 times that distance
with 0.73. The threshold lies between: most vectors at the radius itself are verified, more of nearer ones, and few of
those far away.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .vectors import matrix, usable

PROJECTIONS, WIDTH, SHARE, GROWTH, SEED = 192, 1.5, 0.825, 1.12, 17
#: Rows of a shard: SHARD_ROOT times the root of all rows, between SHARD_ROWS and MAX_SHARD. Queries of a block: so many for
#: each row of a shard in the first, and as many as MAX_SHARD in all others.
SHARD_ROWS, MAX_SHARD, SHARD_ROOT, FIRST_BLOCK = 8192, 65_536, 36, 0.125
#: Parts of a sorted array, counted in a byte: windows are taken up to whole parts.
PARTS = 256


class Shard:
    """The sorted projections of one shard's vectors."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, longest: float):
        order = np.argsort(ids, kind="stable")
        self.x, self.ids = x[order], ids[order]
        rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", self.x, self.x), 0))
        self.longest = longest
        self.axes = np.random.default_rng(SEED).standard_normal((x.shape[1] + 1, PROJECTIONS))
        values = (np.column_stack([self.x, rest]) @ self.axes).T
        order = np.argsort(values, axis=1)
        # Each sorted array in equal parts: their least and largest values, and the part in which each vector stands.
        n = len(x)
        starts = np.unique(np.arange(PARTS) * n // PARTS)
        ends = np.append(starts[1:], n) - 1
        sorted_values = np.take_along_axis(values, order, axis=1)
        self.least, self.largest = sorted_values[:, starts], sorted_values[:, ends]
        self.parts = np.empty(values.shape, np.uint8)
        np.put_along_axis(self.parts, order, np.repeat(np.arange(len(starts)), ends - starts + 1).astype(np.uint8)[None, :], axis=1)
        self.held, self.inside = np.empty(values.shape, np.uint8), np.empty(values.shape, bool)
        self.verified = 0

    def windows(self, at: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last part that a query's window touches in each array; the last stands before the first if there is none."""
        return (self.largest < (at - WIDTH * radius)[:, None]).sum(axis=1), (self.least <= (at + WIDTH * radius)[:, None]).sum(axis=1) - 1

    def collisions(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """In how many windows each vector lies."""
        np.subtract(self.parts, first.astype(np.uint8)[:, None], out=self.held)  # smaller parts wrap around
        np.less_equal(self.held, (last - first).astype(np.uint8)[:, None], out=self.inside)
        if (none := last < first).any():
            self.inside[none] = False
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, first: float, least: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (positions, products) of the k best found, best first, ties to the smaller id.

        least: products that are enough, if known: the radius is where a product of that size lies. Else it grows from first.
        """
        n, m = len(self.ids), len(self.parts)
        scale = self.longest / np.linalg.norm(queries, axis=1)
        at = np.column_stack([queries * scale[:, None], np.zeros(len(queries))]) @ self.axes
        far = lambda product, s: np.sqrt(np.maximum(0.0, 2 * self.longest**2 - 2 * product * s)) * (1 + 1e-9) + 1e-9 * self.longest
        limits = np.full(len(queries), np.inf) if least is None else far(least, scale)
        radii = np.full(len(queries), first) if least is None else limits
        out = []
        for i, q in enumerate(queries):
            radius, limit = radii[i], limits[i]
            done = np.zeros(n, bool)
            done[np.searchsorted(self.ids, own[i]) : np.searchsorted(self.ids, own[i], side="right")] = True
            goal = min(k, n - int(done.sum()))
            found, products = np.zeros(0, np.int64), np.zeros(0)
            while goal:
                low, high = self.windows(at[i], radius)
                passed = np.nonzero((self.collisions(low, high) >= SHARE * m) & ~done)[0]
                done[passed] = True
                self.verified += len(passed)
                found, products = np.append(found, passed), np.append(products, self.x[passed] @ q)
                if len(found) >= goal:
                    limit = min(limit, far(np.partition(products, len(products) - goal)[len(products) - goal], scale[i]))
                if radius >= limit * (1 - 1e-9) or (high - low).min() == self.least.shape[1] - 1:
                    break
                radius = min(radius * GROWTH, limit)
            best = np.lexsort((self.ids[found], -products))[:k]
            out.append((found[best], products[best]))
        return out

    def reach(self, k: int) -> float:
        """A first radius: the median distance at which few of the shard's own vectors have k others."""
        some = self.x[:: max(1, len(self.x) // 32)][:32]
        near = np.sort(some @ self.x.T / np.linalg.norm(some, axis=1, keepdims=True), axis=1)[:, -min(k + 1, len(self.x))]
        return float(max(np.sqrt(np.maximum(0, 2 * self.longest**2 - 2 * self.longest * np.median(near))) / GROWTH**2, self.longest * 1e-3))


def nearest(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """For the rows where `queries` is true: query_id, rank (from 1), vec_id, score (inner product in doubles), the k nearest
    found among all rows but those with the query's own id, nearest first, ties to the smaller id.

    Null, zero or non-finite vectors and null ids take no part; only vectors with as many components are compared. Fewer
    candidates than k: all of them. Of rows that repeat an id each is a candidate, and the shortest, smallest vector asks.
    Empty table: empty result. Work grows with queries times rows, as every query is put to every shard; shards and query
    blocks are of bounded size.
    """
    ids = F.col(id_col).cast("long")
    live = vectors.where(usable(F.col(vector_col)) & ids.isNotNull()).select(ids.alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), F.coalesce(queries, F.lit(False)).alias("q"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = {r["dim"]: r for r in live.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q"), F.max(norm).alias("longest")).collect()}
    rows_of = {d: max(SHARD_ROWS, min(MAX_SHARD, int(SHARD_ROOT * r["n"] ** 0.5))) for d, r in found.items()}
    shards = {d: -(-r["n"] // rows_of[d]) for d, r in found.items()}
    firsts = {d: max(1, -(-r["q"] // max(1, int(rows_of[d] * FIRST_BLOCK)))) for d, r in found.items()}
    blocks = {d: max(1, -(-r["q"] // MAX_SHARD)) for d, r in found.items()}
    longest = {d: r["longest"] for d, r in found.items()}
    pick = lambda sizes: F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, n)])[F.col("dim")] if sizes else F.lit(1)
    # Rows are dealt by all that they hold and their place in the table, so that neither an id nor a copy crowds a shard.
    data = live.withColumn("shard", F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), pick(shards)).cast("int"))
    asked = live.where("q").groupBy("id").agg(F.min(F.struct("dim", "v")).alias("row")).select("id", "row.dim", "row.v")

    def search(rows: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if rows.num_rows and asking.num_rows:
            dim = rows["dim"][0].as_py()
            shard = Shard(matrix(rows["v"], dim), rows["id"].to_numpy(), longest[dim])
            own, known = asking["id"].to_numpy(), asking["least"].to_numpy()
            told = np.isfinite(known)
            for some, least in ((~told, None), (told, known[told])):
                if some.any():
                    q = matrix(asking["v"].filter(pa.array(some)), dim)
                    first = shard.reach(k) if least is None else 0.0
                    for name, (at, score) in zip(own[some].tolist(), shard.search(q, own[some], k, first, least), strict=True):
                        out["query_id"] += [name] * len(at)
                        out["vec_id"] += shard.ids[at].tolist()
                        out["score"] += score.tolist()
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    def run(rows: DataFrame, asking: DataFrame, blocks: dict[int, int], to: Column) -> DataFrame:
        """Each block of queries meets the shards `to`; rows are copied once per block."""
        keys = ["dim", "shard", "block"]
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), pick(blocks) - 1))).select(*keys, "id", "v")
        asking = asking.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), pick(blocks)).cast("int")).withColumn("shard", F.explode(to)).select(*keys, "id", "v", "least")
        asking = asking.toDF(*asking.columns)  # columns of its own: both sides come from one table
        return rows.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")

    # One shard, a sample by hash, is searched first. Its j-th product bounds how far the others look, where j is the place
    # in it of the k-th product of all rows, with two standard deviations to spare; without enough answers, nothing does.
    unknown = F.lit(float("nan"))
    scouted = materialize(run(data.where("shard = 0"), asked.withColumn("least", unknown), firsts, F.array(F.lit(0))), "ann-scout")
    place = {d: min(k, int(k / n + 2 * (k / n) ** 0.5) + 1) for d, n in shards.items()}
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    bounds = scouted.withColumn("nth", nth).select("query_id", F.col("score").alias("kth"), "nth")
    told = asked.join(materialize(bounds, "ann-bounds"), (F.col("id") == F.col("query_id")) & (F.col("nth") == pick(place)), "left").withColumn("least", F.coalesce("kth", unknown)).drop("query_id", "kth", "nth")
    others = told.where(pick(shards) > 1)
    part = scouted.unionByName(run(data.where("shard > 0"), others, blocks, F.sequence(F.lit(1), F.greatest(pick(shards) - 1, F.lit(1)))))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
