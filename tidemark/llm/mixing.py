"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a 60-bit hash of its id. A source is taken whole as often as its target allows; what then remains of
its target is a budget, spent on the documents with the smallest hashes. The hash below which they lie is found without
sorting documents: sizes are summed by source and by the leading 12 bits of the hash, the bucket in which the running sum
passes the budget is the boundary, and only the documents of that bucket are summed again by the next 12 bits. After five
such levels the threshold is exact, so the same rows always give the same mix, and a larger budget takes a superset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused, word_count

LEVEL_BITS, LEVELS = 12, 5


def hash60(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key's text, as a non-negative long; null counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_copies: int) -> DataFrame:
    """Per source (key, source_size): target by weight, none above max_copies times its size, the excess reshared.

    Sources in the order of size per weight: those that reach their cap come first, and from the first that doesn't,
    all share what is left by weight. The windows run over one row per source.
    """
    pos = (F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (pos + 1).cast("int"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.select("src", "source_size", weight.alias("w")).withColumn("cap", max_copies * F.col("source_size").cast("double"))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("total"),
        F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
        F.row_number().over(by_cap).alias("pos"),
    ).withColumn("level", (F.col("total") - F.col("capped")) / F.col("w_left"))
    free = F.col("cap") > F.col("w") * F.col("level")
    level = F.min(F.when(free, F.struct("pos", "level"))).over(whole)
    return ranked.withColumn("first_free", level).select(
        "src", "source_size",
        F.when((F.col("first_free").isNull()) | (F.col("pos") < F.col("first_free.pos")), F.col("cap")).otherwise(F.col("w") * F.col("first_free.level")).alias("target"),
    )


def mix_limits(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.0,
    max_copies: int = 3,
) -> tuple[DataFrame, DataFrame]:
    """The narrow rows (doc_id, source, size, h), and per source (src, source_size, target, whole, threshold)."""
    base = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h")),
        "mix-sizes",
    )
    sizes = base.groupBy(F.col("source").alias("src")).agg(F.sum("size").alias("source_size"))
    state = source_targets(sizes, weights, share, max_copies)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = materialize(state.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")

    # Level by level: prefix, the boundary bucket's leading bits; left, the budget that is left for that bucket.
    bound = state.select("src", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(LEVELS):
        bits = F.shiftright("h", LEVEL_BITS * (LEVELS - level - 1))
        rows = base.select("source", "size", bits.alias("bits"))
        inside = rows.join(bound, F.col("source").eqNullSafe(F.col("src")) & (F.shiftright("bits", LEVEL_BITS) == F.col("prefix")))
        sums = inside.groupBy("src", "bits").agg(F.sum("size").alias("s"), F.first("left").alias("left"))
        upto = F.sum("s").over(Window.partitionBy("src").orderBy("bits"))
        past = sums.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        nxt = past.groupBy("src").agg(F.min(F.struct("bits", (F.col("left") - (F.col("upto") - F.col("s"))).alias("rest"))).alias("b"))
        bound = materialize(nxt.select("src", F.col("b.bits").alias("prefix"), F.col("b.rest").alias("left")), "mix-bound")

    at = bound.select(F.col("src").alias("at"), F.col("prefix").alias("threshold"))
    limits = state.join(at, F.col("src").eqNullSafe(F.col("at")), "left").select("src", "source_size", "target", "whole", "threshold")
    return base, materialize(limits, "mix-limits")


def copies_of(h: Column, max_copies: int) -> Column:
    """How often a document is taken: its source's whole passes, and once more below the threshold."""
    extra = F.when(F.col("source_size") == 0, 0).when(h < F.col("threshold"), 1).otherwise(0)
    return F.least(F.col("whole") + extra, F.lit(max_copies)).cast("int")


def mix_sources(docs: DataFrame, *, max_copies: int = 3, **options) -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size, target, copies, taken (copies times size).

    Null text: size 0. Null source: a source of its own, last in order. Rows that share an id are taken or left together.
    A source without words has target 0 and copies 0. An empty table gives an empty result. Other columns are ignored.
    """
    base, limits = mix_limits(docs, max_copies=max_copies, **options)
    mixed = base.join(limits, F.col("source").eqNullSafe(F.col("src"))).withColumn("copies", copies_of(F.col("h"), max_copies))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", max_copies: int = 3, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names. Texts aren't
    shuffled.

    Null text has no words and null source is a source of its own, last in order; documents of a source without words go.
    Rows that share an id are taken or left together, repeated rows each as often as the others. Empty table: empty result.
    """
    _, limits = mix_limits(docs, id_col=id_col, source_col=source_col, max_copies=max_copies, **options)
    at, rest = unused(docs, "mix"), unused(docs, "mix_copy")
    limits = limits.select(F.struct(*limits.columns).alias(at))
    extra = F.when(F.col(f"{at}.source_size") == 0, 0).when(hash60(F.col(id_col)) < F.col(f"{at}.threshold"), 1).otherwise(0)
    copies = F.least(F.col(f"{at}.whole") + extra, F.lit(max_copies)).cast("int")
    joined = docs.join(limits, F.col(source_col).eqNullSafe(F.col(f"{at}.src"))).where(copies > 0)
    return joined.withColumn(rest, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
