"""Phrase collocation mining: frequent phrases of two to five words that keep together more than their parts would.

Texts fall into pieces at punctuation; identical pieces become one with a multiplicity. Word n-grams, weighted by it, are
summed within each task, dealt to hash buckets, and counted there by duckdb, which spills to disk what doesn't fit. Only
n-grams that can be frequent are dealt: a phrase is at most as frequent as each of its parts, so two words are counted where
both are frequent, and more where all their pairs are. Which words and pairs are frequent is a bitmap of a fixed size: what it
lets through by chance is counted and falls under the threshold, so it changes the work and never a result.

The counts of a candidate's parts are asked for by requests that are shuffled to the parts' counts and answered there.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, materialize, shuffle_partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of pieces that a task holds before it sums their n-grams, and memory of a bucket's duckdb before it spills.
HELD, MEMORY = 12 << 20, "256MB"
ROWS = "lang string, phrase string, words int, times long"
ROW_SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("times", pa.int64())])
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, piece, times): distinct pieces, their words joined by single spaces."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    parts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    words = F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " "))
    return parts.select("lang", words.alias("piece")).where("piece != ''").groupBy("lang", "piece").agg(F.count(F.lit(1)).alias("times"))


def word_hash(lang: str, words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(f"{lang}\t{w}".encode()) for w in words), np.uint64, len(words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = (a * MULTIPLIER) ^ (b + (a >> np.uint64(29)))
    return mixed * MULTIPLIER ^ (mixed >> np.uint64(31))


def spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def among(known: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the bitmap knows."""
    at = spots(hashes, bits)
    return (known[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct key, and the sum of its weights."""
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    return order[edges], np.add.reduceat(weights[order], edges)


def ngrams(lang: str, pieces: pa.Array, times: np.ndarray, sizes: tuple[int, ...], known: np.ndarray | None, bits: int) -> Iterator[pa.RecordBatch]:
    """Summed n-grams of one language's pieces. known: of sizes (2,) the frequent words, of larger ones the frequent pairs."""
    split = pc.split_pattern(pieces, " ")
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    words = split.flatten().dictionary_encode()
    names, code = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    weight, home = np.repeat(times, lengths), np.repeat(np.arange(len(lengths)), lengths)

    def rows(first: np.ndarray, total: np.ndarray, size: int) -> pa.RecordBatch:
        phrase = pc.binary_join_element_wise(*[names.take(pa.array(code[first + k])) for k in range(size)], " ") if size > 1 else names.take(pa.array(code[first]))
        n = len(first)
        return pa.RecordBatch.from_arrays([pa.repeat(lang, n), phrase, pa.repeat(pa.scalar(size, pa.int32()), n), pa.array(total, pa.int64())], schema=ROW_SCHEMA)

    if sizes == (1,):
        if len(code):
            yield rows(*summed(code, weight), 1)
        return
    hashes = word_hash(lang, names.to_pylist())
    beside = home[:-1] == home[1:]  # place i and i + 1 are of one piece
    if sizes == (2,):
        good = among(known, hashes, bits)[code]
        at = np.flatnonzero(beside & good[:-1] & good[1:])
        if len(at):
            first, total = summed(code[at] * len(names) + code[at + 1], weight[at])
            yield rows(at[first], total, 2)
        return
    pair = np.zeros(len(code), bool)
    at = np.flatnonzero(beside)
    pair[at] = among(known, pair_hash(hashes[code[at]], hashes[code[at + 1]]), bits)
    at = np.flatnonzero(pair)
    # An n-gram's number is that of its first n - 1 words together with its last word's.
    number = np.zeros(len(code), np.int64)
    number[at] = np.unique(code[at] * len(names) + code[at + 1], return_inverse=True)[1]
    for size in range(3, max(sizes) + 1):
        at = at[at + size - 1 < len(code)]
        at = at[pair[at + size - 2]]
        if not len(at):
            return
        keys = number[at] * len(names) + code[at + size - 1]
        if size in sizes:
            first, total = summed(keys, weight[at])
            yield rows(at[first], total, size)
        number[at] = np.unique(keys, return_inverse=True)[1]


def counted(pieces: DataFrame, sizes: tuple[int, ...], least: int, known, bits: int) -> DataFrame:
    """(lang, phrase, words, times, spot) of n-grams of the sizes that occur at least so often. known: a broadcast bitmap."""

    def emit(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        langs = whole.column("lang").combine_chunks()
        for lang in langs.unique().to_pylist():
            own = whole.filter(pc.equal(langs, lang))
            text, times = own.column("piece").combine_chunks(), own.column("times").to_numpy()
            yield from ngrams(lang, text, times, sizes, known.value if known else None, bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # Spark's own local folders take the spill; it goes with the task.
        place = (os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()).split(",")[0]
        with tempfile.TemporaryDirectory(prefix="ngrams-", dir=place) as folder, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False}) as con:
            con.register("dealt", pa.RecordBatchReader.from_batches(ROW_SCHEMA, batches))
            found = con.sql(f"SELECT lang, phrase, words, CAST(SUM(times) AS BIGINT) AS times FROM dealt GROUP BY ALL HAVING SUM(times) >= {least}")
            for batch in found.to_arrow_reader(1 << 16):
                yield with_spots(batch, bits)

    dealt = pieces.mapInArrow(deal, ROWS).repartition(shuffle_partitions(pieces.sparkSession), "lang", "phrase")
    return dealt.mapInArrow(count, f"{ROWS}, spot long")


def with_spots(batch: pa.RecordBatch, bits: int) -> pa.RecordBatch:
    """The batch and each word's or pair's place in a bitmap; longer phrases have none."""
    out = []
    for lang, phrase, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        h = word_hash(lang, phrase.split(" ")) if size < 3 else None
        out.append(None if h is None else int(spots(h if size == 1 else pair_hash(h[:1], h[1:]), bits)[0]))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "spot"])


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, bits: int = 26
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases by score descending, a descending, phrase.

    Null texts count as empty, null languages as und; texts without words add nothing, and an empty table gives no rows. Other
    columns are ignored, repeated rows count as often as they occur, texts may be of any length. a is the phrase's count, l
    and r those of the two parts at the cut with the lowest score, n all words of the language; a phrase that stands inside a
    longer one as often as that one is left out. bits: the size of the bitmaps, to be raised with the vocabulary.
    """
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, text_col, lang_col), "pieces")
    totals = pieces.groupBy("lang").agg(F.sum(F.col("times") * (F.regexp_count("piece", F.lit(" ")) + 1)).alias("n"))
    known, levels = None, []
    for sizes in ((1,), (2,), tuple(range(3, longest + 1))):
        levels.append(materialize(counted(pieces, sizes, least, known, bits), "phrases"))
        if len(sizes) == 1:
            known = bitmap(spark, levels[-1], "spot", bits)
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    words = F.split("phrase", " ")
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("times").alias("a"), words.alias("each"))

    def joined(start: Column | int, length: Column) -> Column:
        return F.array_join(F.slice("each", start, length), " ")

    cuts = candidates.select("lang", "phrase", "a", "words", "each", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(True).alias("left"), joined(1, F.col("k")).alias("part")), F.struct(F.lit(False).alias("left"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("part")))
    requests = cuts.select("lang", "phrase", "a", "k", F.explode(sides).alias("side")).select("lang", "phrase", "a", "k", "side.left", "side.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("times").alias("f")), ["lang", "part"])
    both = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(17,0)")  # noqa: E731  products stay within 38 digits
    scored = both.join(totals, "lang").withColumns({"over": F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inside = candidates.where("words > 2").select("lang", "a", "words", "each", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inside = inside.select("lang", "a", "each", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("start"))
    around = inside.groupBy("lang", joined(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = best.join(around, ["lang", "phrase"], "left").where("around IS NULL OR around < a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
