"""Running aggregates over very long keys.

A window over one key runs in one task. Here a hot key's events are dealt out by spans of time: each span is a window of its
own, and what all earlier spans add up to comes from a table of one row per key and span. A hot key is thus spread over as
many tasks as it has spans, and every frame is a prefix, which costs the same per row whatever its length. All other keys,
where such a table would be about as large as the events, are one window each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: How what earlier spans add up to (a) and the own span's part (b) combine.
COMBINE = {"sum": "coalesce({a}, 0) + coalesce({b}, 0)", "min": "least({a}, {b})", "max": "greatest({a}, {b})"}


#: Rows of a key from which on its prefixes are dealt out by spans, and those from which on its sliding frames become prefixes.
LONG, WIDE = 1 << 17, 1 << 10


#: Rows of a task where keys are dealt for windows: what a task sorts doesn't grow with the input.
ROWS = 1 << 17


def hot_keys(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame | bool:
    """The keys of at least so many rows, of which there are few; False if there are none."""
    found = materialize(rows.groupBy(*keys).count().where(F.col("count") >= least).select(*keys), "hot-keys")
    return found if found.head(1) else False


def hot_keys_and_rows(rows: DataFrame, keys: Sequence[str], least: int) -> tuple[DataFrame | bool, int]:
    """The same, and how many rows there are, from one pass."""
    counts = materialize(rows.groupBy(*keys).count(), "key-counts")
    n, most = counts.agg(F.sum("count"), F.max("count")).first()
    return counts.where(F.col("count") >= least).select(*keys) if n and most >= least else False, n or 0


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by a key to so many tasks that of `rows` each gets some ROWS."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS)), key)


def apart(rows: DataFrame, keys: Sequence[str], hot: DataFrame | bool) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other keys, rows of hot keys or None). hot: from hot_keys, True for all keys."""
    if hot is False:
        return rows, None
    if hot is True:
        return rows.where("false"), rows
    few = F.broadcast(hot)  # at most one key for each LONG or WIDE rows
    return rows.join(few, list(keys), "left_anti").select(*rows.columns), rows.join(few, list(keys), "left_semi").select(*rows.columns)


def span_totals(events: DataFrame, keys: Sequence[str], time: str, columns: Mapping[str, tuple[str, str]], span: int) -> DataFrame:
    """Per key and span, the aggregates of that span alone; map-side partial aggregation takes care of hot keys."""
    return events.groupBy(*keys, F.expr(f"floor({time} / {span}) AS _span")).agg(*[F.expr(f"{kind}({sql}) AS _t_{name}") for name, (kind, sql) in columns.items()])


def with_running(
    events: DataFrame,
    keys: Sequence[str],
    time: str,
    span: int,
    *,
    at: Mapping[str, tuple[str, str]] | None = None,
    before: Mapping[str, tuple[str, str]] | None = None,
    tie: str | None = None,
    totals: DataFrame | None = None,
    hot: DataFrame | bool = True,
) -> DataFrame:
    """events plus running aggregates per key, by ("sum" | "min" | "max", SQL expression).

    at: over all events up to the same time, those at that time included; before: over those strictly before by (time,
    tie). totals may be passed where span_totals has a cheaper source than events. Keys must not be null. hot: the keys that
    are dealt out by spans, by columns that are all among keys; True: all of them, False: none.
    """
    at, before = dict(at or {}), dict(before or {})
    if hot is not True:
        some = list(keys) if hot is False else hot.columns
        cold, dense = apart(events, some, hot)
        whole = with_prefixes(cold, keys, time, at, before, tie)
        return whole if dense is None else whole.unionByName(with_running(dense, keys, time, span, at=at, before=before, tie=tie, totals=totals))
    columns = at | before
    totals = span_totals(events, keys, time, columns, span) if totals is None else totals
    by = ", ".join(keys)
    earlier = f"OVER (PARTITION BY {by} ORDER BY _span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = totals.selectExpr(*[f"{k} AS _k{i}" for i, k in enumerate(keys)], "_span AS _s", *[f"{kind}(_t_{name}) {earlier} AS _c_{name}" for name, (kind, _) in columns.items()])
    on = " AND ".join(["_span = _s", *[f"{k} = _k{i}" for i, k in enumerate(keys)]])
    joined = events.selectExpr("*", f"floor({time} / {span}) AS _span").join(carried, F.expr(on), "left")
    upto = f"OVER (PARTITION BY {by}, _span ORDER BY {time} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    prior = f"OVER (PARTITION BY {by}, _span ORDER BY {', '.join([time, tie] if tie else [time])} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def value(name: str, over: str) -> str:
        kind, sql = columns[name]
        return f"{COMBINE[kind].format(a=f'_c_{name}', b=f'{kind}({sql}) {over}')} AS {name}"

    # The finer order comes first: it serves the coarser one too, and rows are sorted once.
    if before:
        joined = joined.selectExpr(*events.columns, "_span", *[f"_c_{name}" for name in at], *[value(name, prior) for name in before])
    return joined.selectExpr(*events.columns, *before, *[value(name, upto) for name in at])


def with_prefixes(events: DataFrame, keys: Sequence[str], time: str, at: Mapping[str, tuple[str, str]], before: Mapping[str, tuple[str, str]], tie: str | None) -> DataFrame:
    """The same with one window a key; no exchange where events are dealt by some of the keys already."""
    by = ", ".join(keys)
    upto = f"OVER (PARTITION BY {by} ORDER BY {time} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    prior = f"OVER (PARTITION BY {by} ORDER BY {', '.join([time, tie] if tie else [time])} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def value(name: str, kind: str, sql: str, over: str) -> str:
        found = f"{kind}({sql}) {over}"
        return f"{f'coalesce({found}, 0)' if kind == 'sum' else found} AS {name}"

    out = events.selectExpr("*", *[value(name, *v, prior) for name, v in before.items()]) if before else events
    return out.selectExpr("*", *[value(name, *v, upto) for name, v in at.items()]) if at else out


def with_ranked(counts: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), down: bool = False, ranges: int = 256, held: bool = False) -> DataFrame:
    """counts plus, for each column of sums, upto_<column>: its sum over values up to the row's own (from the largest down, if
    down), and all_<column>: its sum over all. counts: one row per group and value, values neither null nor NaN; held: it is a
    written table.

    A global order in one task is avoided: values are cut into ranges at approximate quantiles, each range is a window of
    its own, and what the ranges before add up to comes from a table of one row per group and range.
    """
    from pyspark.ml.feature import Bucketizer

    # Read three times: for the cuts, for what the ranges add up to, and dealt.
    counts = counts if held else materialize(counts, "ranked-counts")
    shares = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = counts.agg(F.percentile_approx(F.col(value).cast("double"), shares, 10_000)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    ranged = counts.withColumn("_at", F.col(value).cast("double"))
    ranged = Bucketizer(splits=splits, inputCol="_at", outputCol="_range").transform(ranged) if len(splits) > 2 else ranged.withColumn("_range", F.lit(0.0))
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    order = F.desc if down else F.asc
    before = Window.partitionBy(*by).orderBy(order("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    carried = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in sums], *[F.sum(f"_s_{c}").over(whole).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = ranged.join(F.broadcast(carried), [*by, "_range"])  # a row a group and range; groups are few
    return joined.select(*counts.columns, *[(F.col(f"_c_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


#: Merges the state (n, mean, m2) of what stands before with that of a part, m2 being the sum of squares around the mean.
MERGED = "named_struct('n', {a}.n + {b}.n, 'mean', {a}.mean + ({b}.mean - {a}.mean) * {b}.n / greatest({a}.n + {b}.n, 1), 'm2', {a}.m2 + {b}.m2 + pow({b}.mean - {a}.mean, 2) * {a}.n * {b}.n / greatest({a}.n + {b}.n, 1))"
STATE = "named_struct('n', count({x}){over}, 'mean', coalesce(avg({x}){over}, 0D), 'm2', coalesce(var_pop({x}){over} * count({x}){over}, 0D))"


def with_moments(events: DataFrame, keys: Sequence[str], time: str, span: int, value: str, *, tie: str) -> DataFrame:
    """events plus moments: (n, mean, m2) of value (SQL, in doubles) over the key's events strictly before by (time, tie).

    States are merged instead of sums of squares subtracted, so a small spread around a large mean keeps its digits. A key's
    spans are folded in one row of one small state each; its events are dealt by spans. Keys must not be null.
    """
    by = ", ".join(keys)
    spans = events.groupBy(*keys, F.expr(f"floor({time} / {span}) AS _span")).agg(F.expr(f"{STATE.format(x=value, over='')} AS _state"))
    zero = "named_struct('n', 0L, 'mean', 0D, 'm2', 0D)"
    merged = MERGED.format(a="s.at", b="x._state")
    fold = f"aggregate(_all, named_struct('at', {zero}, 'out', CAST(array() AS array<struct<_s: bigint, _c: struct<n: bigint, mean: double, m2: double>>>)), (s, x) -> named_struct('at', {merged}, 'out', concat(s.out, array(named_struct('_s', x._span, '_c', s.at)))), s -> s.out)"
    carried = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_span", "_state"))).alias("_all")).selectExpr(*[f"{k} AS _k{i}" for i, k in enumerate(keys)], f"inline({fold})")
    on = " AND ".join(["_span = _s", *[f"{k} = _k{i}" for i, k in enumerate(keys)]])
    joined = events.selectExpr("*", f"floor({time} / {span}) AS _span").join(carried, F.expr(on), "left")
    over = f" OVER (PARTITION BY {by}, _span ORDER BY {time}, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    own = joined.selectExpr(*events.columns, "_c", f"{STATE.format(x=value, over=over)} AS _own")
    return own.selectExpr(*events.columns, f"{MERGED.format(a='_c', b='_own')} AS moments")
