"""Source divergence audit: how far the words of two sources of a language, or of a source and its language, lie apart.

For two groups the measure is a sum over all kept terms of f(p, q) = floor((p - q)^2 / (p + q)), p and q smoothed shares in
parts of 10^9. Terms are split in two:

* Heavy terms occur in at least half of a language's groups. Their shares become dense tiles, groups by terms, and numpy sums
  f over each two rows of a tile. Tiles are cut by blocks of groups and by shards of terms, so none grows with the input.
* Light terms are sparse. With p0 the share of a group that lacks a term, their sum for groups i and j is
  (number of light terms) * f(p0i, p0j), plus for each posting of i what f(p, p0j) differs from that, which is summed over a
  histogram of the group's shares, plus for each two postings of one term what both together add to the two single changes.

All of it is whole numbers, so the partial sums add up to the plain sum exactly. p is taken in decimals, as count * 10^9 may
pass 64 bits; from there on, shares are at most 10^9 + 1 and their squares fit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1_000_000_000
#: Distinct terms that a task holds before it hands on their counts.
HELD_TERMS = 400_000
#: Groups in a block, and terms in a shard, of a dense tile; a term is heavy from this share of its language's groups.
BLOCK, SHARD, HEAVY = 256, 2048, 0.5
#: Groups from which on a term is heavy in any case, so that lists of postings stay short.
LONG_LIST = 512
#: Pair sums that a task holds before it hands them on.
HELD_PAIRS = 2_000_000
#: Groups of all languages up to which their table is broadcast, so that no language's rows meet in one task.
BROADCAST_GROUPS = 100_000


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term, and documents with it, summed within tasks and then over all."""
    find = re.compile(rb"[a-z\x80-\xff]+").findall  # in UTF-8, all characters above ASCII are such bytes
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, len(terms)), pa.repeat(source, len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in terms], pa.int64())], schema=schema
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):
                n, d = held.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                terms = find(batch.column(2)[k].as_py().lower())  # of bytes: only A-Z change
                before = len(n)
                n.update(terms)
                d.update(set(terms))
                size += len(n) - before
                if size >= HELD_TERMS:
                    yield from emit(held)
                    held, size = {}, 0
        yield from emit({k: v for k, v in held.items() if v[0]})

    src = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    found = src.mapInArrow(work, "lang string, source string, term string, n long, d long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * kept)); 1 where no term is kept."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (F.col(count).cast("decimal(18,0)") + 2)
    under = F.col(total).cast("decimal(19,0)") + 2 * F.col(kept).cast("decimal(18,0)")
    return F.when(F.col(kept) == 0, F.lit(1).cast("long")).otherwise(1 + F.call_function("div", over, under))


def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f(p, q) of int64 arrays."""
    d = p - q
    return d * d // (p + q)


class PairSums:
    """Sums by (lang, i, j), handed on as batches when there are many."""

    SCHEMA = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("part", pa.int64())])
    SPARK = "lang string, i int, j int, part long"

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, i: np.ndarray, j: np.ndarray, part: np.ndarray) -> None:
        self.held.setdefault(lang, []).append(((i.astype(np.int64) << 32) | j, part))
        self.size += len(part)

    def full(self) -> bool:
        return self.size > HELD_PAIRS

    def take(self) -> Iterator[pa.RecordBatch]:
        for lang, parts in self.held.items():
            keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, at, np.concatenate([v for _, v in parts]))
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], schema=self.SCHEMA)
        self.__init__()


def posting_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of light terms' postings (lang, gid, p, p0: lists by ascending gid): what each two of them change together."""
    sums = PairSums()
    for batch in batches:
        lists = [batch.column(k) for k in (1, 2, 3)]
        gid, p, p0 = (c.flatten().to_numpy().astype(np.int64) for c in lists)
        sizes = np.diff(lists[0].offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for size in np.unique(sizes[sizes > 1]).tolist():
            left, right = np.triu_indices(size, 1)
            rows = np.flatnonzero(sizes == size)
            for lang in set(langs[rows]):
                own = starts[rows[langs[rows] == lang]]
                step = max(1, 1_000_000 // len(left))
                for k in range(0, len(own), step):
                    a, b = (own[k : k + step, None] + left).ravel(), (own[k : k + step, None] + right).ravel()
                    both = differ(p[a], p[b]) - differ(p[a], p0[b]) - differ(p0[a], p[b]) + differ(p0[a], p0[b])
                    sums.add(lang, gid[a], gid[b], both)
                    if sums.full():
                        yield from sums.take()
    yield from sums.take()


def tile(rows: pa.Table) -> pa.Table:
    """Sums over the terms of one tile: (lang, i, j, part) for groups i of one block and j of another, or the same, i < j."""
    first, second = rows.column("block_i")[0].as_py(), rows.column("block_j")[0].as_py()
    gid, p = rows.column("gid").to_numpy(), rows.column("p").to_numpy()
    base = rows.column("term").combine_chunks().is_null().to_numpy(zero_copy_only=False)
    codes = rows.column("term").combine_chunks().dictionary_encode()
    code = codes.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(gid[base])
    groups, block = gid[base][order], rows.column("block").to_numpy()[base][order]
    dense = np.zeros((len(groups), len(codes.dictionary)), np.int64)
    dense[np.searchsorted(groups, gid[base])] = p[base][:, None]  # what a group has of terms that it lacks
    dense[np.searchsorted(groups, gid[~base]), code[~base]] = p[~base]
    out_i, out_j, out = [], [], []
    for k in np.flatnonzero(block == first):
        others = np.flatnonzero((block == second) & (groups > groups[k]))
        if len(others):
            out.append(differ(dense[k][None, :], dense[others]).sum(axis=1))
            out_i.append(np.full(len(others), groups[k]))
            out_j.append(groups[others])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    n = sum(map(len, out))
    return pa.table({"lang": pa.repeat(rows.column("lang")[0].as_py(), n), "i": join(out_i, np.int32), "j": join(out_j, np.int32), "part": join(out, np.int64)}, schema=PairSums.SCHEMA)


def divergence(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other groups of its language (part pair), all of them, and
    the terms it has more of than its language (part term), the first by value.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own, whatever their ids; other columns
    are ignored. A group without kept terms has its pairs and no terms; a language with one group has no pairs; where a language
    keeps no term, pairs have value 0. Equal values rank by item, in UTF-8 order. An empty table gives no rows. Texts may be
    of any length. A term's list holds one entry a group of its language at most; the result has the square of that.
    """
    counts = term_counts(docs, text_col, lang_col, source_col)
    kept = counts.groupBy("lang", "term").agg(F.sum("d").alias("docs"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.collect_list(F.struct("source", "n")).alias("posts"))
    kept = materialize(kept.where(F.col("docs") >= least_docs), "kept-terms")
    cells = kept.select("lang", "term", "total", "k", F.explode("posts").alias("post")).select("lang", "term", "total", "k", "post.source", "post.n")

    # The groups, numbered within their language, with what the shares need.
    seen = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_size"))
    groups = seen.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["size", "v", "lang_size"])
    groups = groups.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("g", F.count(F.lit(1)).over(Window.partitionBy("lang")))
    groups = groups.withColumn("none", F.lit(0)).withColumn("p0", share("none", "size", "v")).drop("none")
    groups = materialize(groups, "groups")
    known = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    heavy = F.col("k") >= F.least(F.ceil(F.col("g") * HEAVY), F.lit(LONG_LIST))
    cells = cells.join(known, ["lang", "source"]).withColumns({"p": share("n", "size", "v"), "q": share("total", "lang_size", "v"), "heavy": heavy})
    cells = materialize(cells.select("lang", "source", "term", "gid", "g", "p", "p0", "q", "heavy"), "cells")

    def f(p: str, q: str) -> Column:
        return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(order))

    over = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), f("p", "q").alias("value"))
    terms = ranked(over).where(F.col("rank") <= top)

    # Pairs i < j of groups: all light terms as if neither had any, then the corrections, then the dense tiles.
    weight = kept.join(groups.select("lang", "g").distinct(), "lang").where(heavy).groupBy("lang").agg(F.count(F.lit(1)).alias("heavy_terms"))
    one, two = (groups.select("lang", F.col("source").alias(f"source_{s}"), F.col("gid").alias(s), F.col("p0").alias(f"p0{s}"), "v") for s in "ij")
    pairs = materialize(one.join(two.drop("v"), "lang").where("i < j"), "pairs")
    base = pairs.join(weight, "lang", "left").select("lang", "i", "j", ((F.col("v") - F.coalesce("heavy_terms", F.lit(0))) * f("p0i", "p0j")).alias("part"))
    light = cells.where("NOT heavy")
    shares = light.groupBy("lang", "gid", "p", "p0").agg(F.count(F.lit(1)).alias("times"))
    there = known.select("lang", F.col("gid").alias("other"), F.col("p0").alias("p0o"))
    alone = shares.join(there, "lang").where("other != gid")
    alone = alone.groupBy("lang", F.least("gid", "other").alias("i"), F.greatest("gid", "other").alias("j")).agg(F.sum(F.col("times") * (f("p", "p0o") - f("p0", "p0o"))).alias("part"))
    posts = light.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("gid", "p", "p0"))).alias("posts")).where(F.size("posts") > 1)
    both = posts.select("lang", F.col("posts.gid").alias("gid"), F.col("posts.p").alias("p"), F.col("posts.p0").alias("p0")).mapInArrow(posting_pairs, PairSums.SPARK)

    shards = weight.select("lang", F.ceil(F.col("heavy_terms") / shard).cast("int").alias("shards")).where("shards > 0")
    rows = cells.where("heavy").join(shards, "lang").select("lang", "term", "gid", "g", "p", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    lacking = groups.join(shards, "lang").select("lang", F.lit(None).cast("string").alias("term"), "gid", "g", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    blocks = F.ceil(F.col("g") / block)
    dealt = rows.unionByName(lacking).withColumn("block", F.floor(F.col("gid") / block).cast("int")).withColumn("against", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    dealt = dealt.select("lang", "shard", F.least("block", "against").alias("block_i"), F.greatest("block", "against").alias("block_j"), "block", "term", "gid", "p")
    tiles = dealt.groupBy("lang", "shard", "block_i", "block_j").applyInArrow(tile, PairSums.SPARK)

    parts = base.unionByName(alone).unionByName(both).unionByName(tiles).groupBy("lang", "i", "j").agg(F.sum("part").alias("value"))
    named = pairs.select("lang", "i", "j", "source_i", "source_j").join(parts, ["lang", "i", "j"])
    ways = F.array(F.struct(F.col("source_i").alias("source"), F.col("source_j").alias("item")), F.struct(F.col("source_j").alias("source"), F.col("source_i").alias("item")))
    both_ways = named.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return ranked(both_ways).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
