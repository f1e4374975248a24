"""SimHash near-duplicates: meet-in-the-middle ball hashing of 64-bit fingerprints.

Two fingerprints at most radius bits apart have a common variant at most radius / 2 bits from each. Every distinct
fingerprint therefore emits all its variants within half the radius, variants meet by a shuffle, and those that several
fingerprints share link them. Buckets of variants are the parities of the variant with fixed random words: such a hash is
linear, so the bucket of a variant follows from the fingerprint's bucket and the flipped bits', and a fingerprint is sent
once to a bucket with all of its variants there, which the receiving task expands, block by block.

near_duplicates links whole texts by one fingerprint each. similar_documents finds texts whose shingles agree to 0.8 or
more: one fingerprint of a whole text can differ by ten bits there, so texts have several, each of a few words around an
anchor that the text's content chooses, searched by the same balls; the pairs that collide are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, bucketed, materialize, pow2_at_least, unused
from .components import connected_components

SEED = 42
#: Variants that one bucket, and one block within it, expands, and fingerprints that one bucket holds.
TASK_VARIANTS, BLOCK_VARIANTS, BUCKET_PRINTS = 64_000_000, 1_000_000, 4_000_000


def simhash(text: str, shingle: int = 4, seed: int = SEED) -> int:
    """The fingerprint: bit i is set if it is set in over half of the XXH64 hashes of the word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: only A-Z change, only the six ASCII white-space characters split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    hashes = np.fromiter((xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 32768):
        part = hashes[k : k + 32768]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = SEED) -> DataFrame:
    """(id, fp) per row; fp is the unsigned fingerprint's bits as a long. Null text counts as empty: 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t, shingle, seed) if t else 0 for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, "id long, fp long")


class Balls:
    """The masks within half the radius, grouped by their bucket difference.

    The random words of the buckets don't overlap, so a flipped bit changes one bit of the bucket at most: a fingerprint goes
    to few buckets (at half the radius 2 and b bits: 1 + b + b (b - 1) / 2 of 2^b), each with all its variants there.
    """

    def __init__(self, radius: int, bits: int, sub_bits: int):
        if radius % 2:
            raise ValueError("the radius must be even")
        flips = [c for k in range(radius // 2 + 1) for c in combinations(range(64), k)]
        self.masks = np.array([sum(1 << b for b in c) for c in flips], dtype=np.uint64)
        self.bits, self.sub_bits = bits, sub_bits
        owner = np.random.default_rng(7).permutation(np.arange(64) % max(1, bits + sub_bits))
        self.words = np.array([sum(1 << int(b) for b in np.nonzero(owner == k)[0]) for k in range(bits + sub_bits)], dtype=np.uint64)
        place = self.place(self.masks)
        order = np.argsort(place, kind="stable")
        self.masks, place = self.masks[order], place[order]
        self.values, self.first, self.count = np.unique(place, return_index=True, return_counts=True)
        self.steps = np.unique(self.values & ((1 << bits) - 1))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The bucket (low bits) and block within it (high bits), linear over exclusive or."""
        out = np.zeros(len(x), np.int64)
        for k, w in enumerate(self.words):
            out |= (np.bitwise_count(x & w).astype(np.int64) & 1) << k
        return out

    def variants(self, fps: np.ndarray, home: np.ndarray, want: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(variants, whose) with that bucket and block: all that meet there, in parts by their hash if they are very many."""
        step = home ^ want
        at = np.minimum(np.searchsorted(self.values, step), len(self.values) - 1)
        n = np.where(self.values[at] == step, self.count[at], 0)
        passes = pow2_at_least(n.sum() / (4 * BLOCK_VARIANTS))
        some = np.nonzero(n)[0]
        cuts = np.searchsorted(np.cumsum(n[some]), np.arange(BLOCK_VARIANTS, n.sum(), BLOCK_VARIANTS)) if passes > 1 else []
        for turn in range(passes):
            parts = []
            for mine in np.split(some, np.unique(cuts).astype(np.int64)):
                m = n[mine]
                who = np.repeat(mine, m)
                which = np.arange(len(who)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[at[mine]], m)
                found = fps[who] ^ self.masks[which]
                if passes > 1:
                    here = (found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & np.uint64(passes - 1) == turn
                    found, who = found[here], who[here]
                parts.append((found, who))
            yield np.concatenate([x for x, _ in parts]), np.concatenate([w for _, w in parts])

    def links(self, fps: np.ndarray, bucket: int, radius: int) -> np.ndarray:
        """Links (smaller, other) between fingerprints that share a variant of this bucket: for each variant from its
        smallest fingerprint to the others, which is enough to connect them."""
        fps = np.unique(fps)
        home = self.place(fps)
        found = [np.zeros((0, 2), np.uint64)]
        for block in range(1 << self.sub_bits):
            for variants, who in self.variants(fps, home, bucket | block << self.bits):
                order = np.argsort(variants)
                variants, who = variants[order], who[order]
                new = np.ones(len(variants) + 1, bool)
                new[1:-1] = variants[1:] != variants[:-1]
                shared = ~(new[:-1] & new[1:])
                who, starts = who[shared], np.nonzero(new[:-1][shared])[0]
                if not len(who):
                    continue
                sizes = np.diff(np.append(starts, len(who)))
                head = np.repeat(np.minimum.reduceat(who, starts), sizes)
                keep = (head != who) & (np.bitwise_count(fps[head] ^ fps[who]) <= radius)
                links = np.unique(head[keep] * len(fps) + who[keep])
                found.append(np.stack([fps[links // len(fps)], fps[links % len(fps)]], axis=1))
        return np.unique(np.concatenate(found), axis=0)


def bucket_plan(n: int, radius: int) -> tuple[int, int]:
    """(bits of the bucket, bits of the block in it) for n fingerprints: a bucket holds at most BUCKET_PRINTS fingerprints
    and TASK_VARIANTS of their variants, a block about BLOCK_VARIANTS, whatever n is."""
    flips = range(radius // 2 + 1)
    masks = sum(comb(64, k) for k in flips)
    bits = 3
    while n * masks / 2**bits > TASK_VARIANTS or n * min(1.0, sum(comb(bits, k) for k in flips) / 2**bits) > BUCKET_PRINTS:
        bits += 1
    return bits, max(0, ceil(log2(max(1, n * masks / 2**bits / BLOCK_VARIANTS))))


def near_links(distinct: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp long), n of them, that connect all within the radius."""
    bits, sub_bits = bucket_plan(n, radius)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = Balls(radius, bits, sub_bits)
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                fps = batch.column(0).slice(k, 8192).to_numpy().view(np.uint64)
                to = ((balls.place(fps) & ((1 << bits) - 1))[:, None] ^ balls.steps[None, :]).ravel()
                order = np.argsort(to, kind="stable")
                to, rows = to[order], fps[order // len(balls.steps)]
                at = np.nonzero(np.append(True, to[1:] != to[:-1]))[0]
                blobs = [x.tobytes() for x in np.split(rows, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "fps"])

    def meet(group: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(group["fps"].to_pylist()), np.uint64)
        links = Balls(radius, bits, sub_bits).links(fps, group["bucket"][0].as_py(), radius).view(np.int64)
        return pa.table({"a": np.ascontiguousarray(links[:, 0]), "b": np.ascontiguousarray(links[:, 1])})

    return distinct.select("fp").mapInArrow(send, "bucket int, fps binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = SEED) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Null text counts as empty: fingerprint 0, linked like any other. Rows with a null id have a fingerprint but take no part
    in linking: component_id null. Repeated rows keep their place. Equal fingerprints are collapsed before any search, so
    groups of copies cost one fingerprint. Empty table: empty result.
    """
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "simhash-fps")
    distinct = materialize(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "simhash-distinct")
    links = materialize(near_links(distinct, distinct.count(), radius), "simhash-links")
    parts = materialize(connected_components(links), "simhash-parts")
    least = distinct.join(parts, F.col("fp") == F.col("node")).groupBy("component").agg(F.min("rep").alias("component_id"))
    least = materialize(parts.join(least, "component").select("node", "component_id"), "simhash-least")
    known = distinct.join(least, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    known = materialize(known, "simhash-known")
    out = fps.join(known, (F.col("fp") == F.col("_fp")) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Fingerprints per text, and words on either side of an anchor, for similar documents.
TABLES, REACH = 10, 6
#: Members of a group up to which its open pairs are listed; larger groups are compared in blocks of so many members.
LISTED, BLOCK = 16, 512
#: A bitmap of wanted rows has so many bits at most (128 MB), and eight for each row at least.
BITMAP_BITS = 30
MIX = np.uint64(0x9E3779B97F4A7C15)
SALTS = np.random.default_rng(SEED).integers(0, 2**64, TABLES, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def node_of(words: list[bytes]) -> int:
    """One key for all texts with the same words in the same order."""
    from xxhash import xxh64_intdigest

    h = xxh64_intdigest(b" ".join(words), SEED)
    return h - (1 << 64) if h >> 63 else h


class WordHashes(dict):
    """Hashes of words, held while there are not too many different ones."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingles_at(w: np.ndarray, shingle: int) -> np.ndarray:
    """A hash for each word shingle in order (fewer words: the whole sequence), mixed from the words' hashes."""
    n, k = max(1, len(w) - shingle + 1), min(shingle, len(w))
    out = np.full(n, k + 1, np.uint64)
    for i in range(k):
        out = (out ^ w[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


def anchored_prints(w: np.ndarray, at: np.ndarray, shingle: int, reach: int = REACH) -> np.ndarray:
    """A fingerprint per table, of the words around the shingle with the smallest hash of that table.

    Two texts have the same anchor in a table with a chance of their Jaccard similarity, and then mostly the same words
    around it, wherever else a block was put in, cut off or changed. Tables are told apart by a word that is put over them.
    """
    if len(w) < shingle:
        return np.zeros(0, np.int64)
    anchors = np.empty(TABLES, np.int64)
    step = max(1, 500_000 // len(at))
    for t in range(0, TABLES, step):
        mixed = (at[None, :] ^ SALTS[t : t + step, None]) * MIX
        anchors[t : t + step] = (mixed ^ (mixed >> np.uint64(32))).argmin(axis=1)
    places = anchors[:, None] + np.arange(-reach, shingle + reach)[None, :]
    inside = (places >= 0) & (places < len(w))
    around = np.ascontiguousarray(w[np.clip(places, 0, len(w) - 1)])
    bits = np.unpackbits(around.view(np.uint8).reshape(*places.shape, 8), axis=2, bitorder="little")
    over_half = 2 * (bits * inside[:, :, None]).sum(axis=1, dtype=np.int64) > inside.sum(axis=1)[:, None]
    return (np.packbits(over_half, axis=1, bitorder="little").view(np.uint64).ravel() ^ SALTS).view(np.int64)


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def close_in_size(a: str, b: str, similarity: float) -> Column:
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left shares with each on the right, as products of the sets' columns."""
    flat = np.concatenate(left + right)
    who = np.repeat(np.arange(len(left) + len(right)), list(map(len, left + right)))
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    several = n > 1
    number = np.cumsum(several) - 1
    who, column = who[several[column]], number[column[several[column]]]
    order = np.argsort(column, kind="stable")
    who, column = who[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(column, [first, first + 4096])
        part = np.zeros((len(left) + len(right), 4096), np.float32)
        part[who[a:b], column[a:b] - first] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label that each row and each column reaches over links."""
    top = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        a2 = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1, initial=top))
        b2 = np.minimum(b, np.where(linked, a2[:, None], top).min(axis=0, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def dealt_blocks(rows: DataFrame) -> DataFrame:
    """rows with own and other: the block of each member and each block that it meets. A component of more than BLOCK members of a
    group has blocks of its own, which don't meet each other, as nothing is to be found there; all others share theirs."""
    part = F.when(F.col("n") > BLOCK, F.col("c"))
    each = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).select("g", "c", "n", part.alias("big"))
    parts = each.groupBy("g", "big").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("k"))
    whole = Window.partitionBy("g")
    parts = parts.select("g", "big", "k", (F.sum("k").over(whole.orderBy("big")) - F.col("k")).cast("int").alias("first"), F.sum("k").over(whole).cast("int").alias("blocks"))
    known = each.alias("e").join(parts.alias("p"), (F.col("e.g") == F.col("p.g")) & F.col("e.big").eqNullSafe(F.col("p.big"))).select("e.g", "e.c", "e.big", "k", "first", "blocks")
    dealt = rows.join(known, ["g", "c"]).withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return every.where(F.col("big").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("k")))


def one_head_each(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (head a, text b, the head's weight), a row per group: of each text's heads that of most of its groups."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight"))
    return counted.groupBy("b").agg(F.max_by("a", F.struct("n", "weight", "a")).alias("a")).select("a", "b")


def blocked_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that connect all similar members of each group; rows: g, node, size, c.

    Blocks of a group's members meet in a task for each two of them, and what leaves it are links that span its components,
    never its pairs.
    """
    dealt = dealt_blocks(rows).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "c")
    dealt = dealt.join(sets, "node").select("g", "i", "j", "own", "c", "s")

    def meet(group: pa.Table) -> pa.Table:
        c, own, i = group["c"].to_numpy(), group["own"].to_numpy(), group["i"][0].as_py()
        members = [np.asarray(x.values) for x in group["s"]]
        x, y = np.nonzero(own == i)[0], np.nonzero(own == group["j"][0].as_py())[0]
        found = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if len(x) and len(y):
            n = np.array(list(map(len, members)), dtype=np.float64)
            common = shared_counts([members[k] for k in x], [members[k] for k in y])
            a, b = spanning((common >= similarity * (n[x][:, None] + n[y][None, :] - common)) | (c[x][:, None] == c[y][None, :]), c[x], c[y])
            ends = np.unique(np.stack([np.concatenate([c[x], c[y]]), np.concatenate([a, b])], axis=1), axis=0)
            ends = ends[ends[:, 0] != ends[:, 1]]
            found = {"a": np.ascontiguousarray(ends[:, 0]), "b": np.ascontiguousarray(ends[:, 1])}
        return pa.table(found)

    return dealt.groupBy("g", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def similar_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, key (of the text), c: rows with the same c belong together; null for a null id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part, nodes, sizes, prints = batch.slice(k, 1024), [], [], []
                for t in part.column(2).to_pylist():
                    words = words_of(t)
                    w = hashes.of(words)
                    at = shingles_at(w, shingle)
                    nodes.append(node_of(words))
                    sizes.append(len(np.unique(at)))
                    prints.append(anchored_prints(w, at, shingle))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64()))], ["id", "key", "node", "size", "prints"])

    def shingles(batches: Iterator[pa.RecordBatch], asked=None, bits: int = 0) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if asked is not None:
                at = batch.column(1).to_numpy() & ((1 << bits) - 1)
                batch = batch.filter(pa.array((asked.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for k in range(0, batch.num_rows, 256):  # the words of few documents at a time are held
                rows = [words_of(t) for t in batch.column(0).slice(k, 256).to_pylist()]
                sets = [np.unique(shingles_at(hashes.of(w), shingle)).view(np.int64) for w in rows]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(w) for w in rows], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    known = materialize(src.mapInArrow(read, "id long, key long, node long, size int, prints array<long>"), "similar-read")
    nodes = known.where("id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "key")).alias("row"), F.first("size").alias("size"), F.first("prints").alias("prints"))
    nodes = materialize(nodes, "similar-nodes")

    # Fingerprints that are linked over variants, in any number of steps, are one group of a table. Texts that share the
    # groups of two tables are candidates: a passage that both have rarely holds two anchors of both.
    prints = materialize(nodes.select("node", "size", F.explode("prints").alias("fp")), "similar-prints")
    distinct = materialize(prints.select("fp").distinct(), "similar-distinct")
    balls = materialize(connected_components(materialize(near_links(distinct, distinct.count(), radius=2), "similar-balls")).select(F.col("node").alias("near"), F.col("component").alias("ball")), "similar-near")
    grouped = prints.join(balls, F.col("fp") == F.col("near"), "left").select("node", "size", F.coalesce("ball", "fp").alias("one"))
    several = materialize(grouped.groupBy("one").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "similar-several")
    lists = grouped.join(several, "one").groupBy("node").agg(F.first("size").alias("size"), F.array_sort(F.collect_set("one")).alias("ones"), F.sum("m").alias("weight")).where(F.size("ones") > 1)
    both = F.flatten(F.transform("ones", lambda x, k: F.transform(F.slice("ones", k + 2, F.size("ones")), lambda y: F.xxhash64(x, y))))
    pairs_of = materialize(lists.select("node", "size", "weight", F.explode(both).alias("g")), "similar-tables")
    held = materialize(pairs_of.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("m > 1").groupBy("m", "who").agg(F.min("g").alias("g")).select("g"), "similar-held")
    shared = materialize(pairs_of.join(held, "g", "left_semi"), "similar-shared")
    wanted = shared.select("node").distinct().join(nodes.select("node", "row.*"), "node").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    wanted = materialize(wanted, "similar-wanted")
    bits = min(BITMAP_BITS, max(20, (16 * wanted.count()).bit_length()))
    if wanted.count() <= 1 << (BITMAP_BITS - 3):
        # A bitmap tells which rows are wanted, so texts are read again without a shuffle; few others slip in, to no effect.
        mark = F.xxhash64("id", "key")
        asked = bitmap(docs.sparkSession, wanted.select(F.xxhash64("_id", "_key").bitwiseAND(F.lit((1 << bits) - 1)).alias("spot")), "spot", bits)
        sets = src.select("text", mark.alias("mark")).mapInArrow(lambda batches: shingles(batches, asked, bits), "node long, s array<long>")
    else:
        texts = src.join(wanted, (F.col("id") == F.col("_id")) & (F.col("key") == F.col("_key")), "left_semi")
        sets = texts.select("text").mapInArrow(shingles, "node long, s array<long>")
    sets = bucketed(sets, "similar-sets", "node")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.distinct(), "similar-pairs")
        one = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = one.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
        common = F.size(F.array_intersect("sa", "sb"))
        return materialize(both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "similar-links")

    links = known.sparkSession.createDataFrame([], "a long, b long")
    parts, turn, before = links.toDF("part", "c"), 0, 0

    def linked(*found: DataFrame) -> None:
        nonlocal links, parts
        for f in found:
            links = links.unionByName(f)
        parts = materialize(connected_components(links).select(F.col("node").alias("part"), F.col("component").alias("c")), "similar-parts")

    size_fits = close_in_size("x", "y", similarity)
    while True:
        rows = shared.join(parts, F.col("node") == F.col("part"), "left").select("g", "node", "size", "weight", F.coalesce("c", "node").alias("c"))
        # Groups of one component are done with.
        per = rows.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("g").agg(F.sum("m").alias("m"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p"))
        per = materialize(per.where("p > 0"), "similar-open")
        left, most = per.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("p"), F.lit(0))).first()
        if not left:
            break
        rows = materialize(rows.join(per.select("g", "m"), "g"), "similar-rows")
        few = F.col("m") <= LISTED
        if most <= 4 * left or (turn and most > before / 2):
            # What is left: all pairs of different components, listed in small groups and compared in blocks in others.
            x, y = (rows.where(few).alias(side) for side in "xy")
            pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & size_fits)
            blocks = materialize(blocked_links(rows.where(~few), sets, similarity), "similar-blocks")
            linked(verified(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), blocks)
            break
        # Large groups fall together by one head each: the text whose fingerprints most others share, as an original shares
        # more of them with its copies than these with each other. A text of many groups goes to one of their heads a turn, so its
        # set moves once, not for each group. This goes on while a turn at least halves the open pairs.
        order = F.struct("weight", F.xxhash64("node")) if turn == 0 else F.struct(F.xxhash64("node", "g", F.lit(turn)))
        heads = materialize(rows.groupBy("g").agg(F.max_by(F.struct("node", "size", "c", "weight"), order).alias("y")), "similar-heads")
        pairs = rows.alias("x").join(heads, "g").where((F.col("y.c") != F.col("x.c")) & size_fits)
        linked(verified(one_head_each(pairs.select(F.col("y.node").alias("a"), F.col("x.node").alias("b"), F.col("y.weight").alias("weight")))))
        turn, before = turn + 1, most
    return known.join(parts, F.col("node") == F.col("part"), "left").select("id", "key", F.when(F.col("id").isNotNull(), F.coalesce("c", "node")).alias("c"))


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per input row: id, component_id (smallest id reachable). Documents link if the Jaccard similarity of their
    word shingles is at least `similarity`.

    Candidates are texts with fingerprints within two bits in two of ten tables (anchored_prints), which pairs at 0.8 miss
    with a chance below one in a hundred; all are verified on the shingles of the whole texts, but for pairs that are linked
    over others already. Texts with the same words are one node. Null text counts as empty; texts without words are copies
    of one another. Texts on rows with one id are told apart. Rows with a null id: component null. Empty table: empty result.
    """
    joined = materialize(similar_rows(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity), "similar-rows")
    least = materialize(joined.where("id IS NOT NULL").groupBy("c").agg(F.min("id").alias("component_id")).withColumnRenamed("c", "_c"), "similar-known")
    return joined.join(least, F.col("c") == F.col("_c"), "left").select(F.col("id").alias(id_col), "component_id")


def without(docs: DataFrame, gone: DataFrame, i: str, k: str, row_id: Column, row_key: Column, match: Column) -> DataFrame:
    """docs without the rows that match one of gone (i, k); rows that a bitmap of gone rules out are not shuffled."""
    n = gone.count()
    bits = max(20, (64 * n).bit_length())
    if bits > BITMAP_BITS:
        return docs.join(gone, match, "left_anti")
    spot = lambda x, y: F.xxhash64(x, y).bitwiseAND(F.lit((1 << bits) - 1))
    listed, mark = bitmap(docs.sparkSession, gone.select(spot(F.col(i), F.col(k)).alias("spot")), "spot", bits), unused(docs, "listed")

    @F.pandas_udf("boolean")
    def perhaps(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((listed.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    marked = docs.withColumn(mark, perhaps(spot(row_id, row_key)))
    return marked.where(~F.col(mark)).drop(mark).unionByName(marked.where(mark).drop(mark).join(gone, match, "left_anti"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one row of each group of similar documents: that with the smallest id, then text key. Of rows
    that repeat both id and text one stays, of rows with one id and different texts one for each group. Rows with a null
    id stay. A bitmap tells which rows are not on the list of dropped ones, and only the texts of others, these and one in 64 at
    most of all, may be shuffled to look."""
    found = materialize(similar_rows(docs, id_col=id_col, text_col=text_col, **options).where("id IS NOT NULL"), "similar-found")
    first = found.groupBy("c").agg(F.min(F.struct("id", "key")).alias("w")).select(F.col("c").alias("of"), "w")
    gone = found.join(first, F.col("c") == F.col("of")).where((F.col("id") != F.col("w.id")) | (F.col("key") != F.col("w.key")))
    i, k = unused(docs, "row_id"), unused(docs, "row_key")
    listed = lambda rows, name: materialize(rows.select(F.col("id").alias(i), F.col("key").alias(k)).distinct(), name)
    gone = listed(gone, "similar-gone")
    again = listed(found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "similar-again")
    match = (F.col(id_col).cast("long") == F.col(i)) & (text_key(F.col(text_col)) == F.col(k))
    kept = without(docs, gone, i, k, F.col(id_col).cast("long"), text_key(F.col(text_col)), match)
    if again.isEmpty():
        return kept
    repeats = kept.join(again, match).dropDuplicates([i, k]).drop(i, k)
    return kept.join(again, match, "left_anti").unionByName(repeats)
