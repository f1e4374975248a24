"""Sliding frames dealt out by spans of time, so that a hot key's frames run in many tasks, and sweeps over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .running import apart, with_running


def with_frame(events: DataFrame, keys: Sequence[str], time: str, width: int, columns: Mapping[str, Column], *, forward: bool = False) -> DataFrame:
    """events plus aggregates over [time - width, time], or [time, time + width] if forward, peers and both ends included.

    Rows are copied to the one neighbouring span from which a frame can reach them; results come from the row's own span.
    """
    home = F.floor(F.col(time) / (width + 1))
    spans = F.array(home, home - 1 if forward else home + 1)
    dealt = events.withColumns({"_home": home, "_span": spans}).withColumn("_span", F.explode("_span"))
    frame = Window.partitionBy(*keys, "_span").orderBy(time).rangeBetween(*((0, width) if forward else (-width, 0)))
    return dealt.select("*", *[c.over(frame).alias(name) for name, c in columns.items()]).where("_span = _home").drop("_span", "_home")


def with_swept(rows: DataFrame, key: str, time: str, ident: str, other: str, width: int, span: int, sums: Mapping[str, str], hot: DataFrame | bool = True) -> DataFrame:
    """The rows where is_anchor, plus for each of sums (SQL of a member) its sum over the members of the key that are the row
    itself or stand after it by (time, ident), at most width later, and n_distinct: their distinct others, '' left out.

    rows: is_anchor, is_member, and columns that are not null. A sweep instead of pairs: a member enters all windows that begin
    at most width before it and leaves those that begin after it, so each anchor's sums are prefixes over entries and exits. A
    member counts for its other from where the pair's previous member has left. Rows cost the same however dense they are.
    hot: the keys for which that is done; others, of few rows, keep their frames and are dealt once.
    """
    if hot is not True:
        cold, dense = apart(rows, [key], hot)
        whole = with_ahead(cold, key, time, ident, other, width, sums)
        return whole if dense is None else whole.unionByName(with_swept(dense, key, time, ident, other, width, span, sums).select(*whole.columns))
    prev = with_running(rows.where("is_member"), [key, other], time, span, before={"_prev": ("max", f"struct({time} AS t, {ident} AS i)")}, tie=ident)
    prev = materialize(prev.unionByName(rows.where("NOT is_member").withColumn("_prev", F.lit(None).cast(prev.schema["_prev"].dataType))), "sweep")
    near = f"coalesce(_prev.t >= {time} - {width}, false)"
    # Kinds of events: 0 the anchor itself; a member 1 enters, 2 leaves, 3 counts for its other only from now on.
    kinds = f"filter(array(IF(is_anchor, 0, NULL), IF(is_member, 1, NULL), IF(is_member, 2, NULL), IF(is_member AND {other} != '' AND {near}, 3, NULL)), k -> k IS NOT NULL)"
    signed = lambda sql: f"CASE kind WHEN 1 THEN {sql} WHEN 2 THEN -({sql}) END"
    distinct = f"CASE WHEN {other} = '' THEN 0 WHEN kind = 3 THEN 1 WHEN kind = 2 THEN -1 WHEN kind = 1 AND NOT {near} THEN 1 ELSE 0 END"
    events = prev.selectExpr("*", f"explode({kinds}) AS kind").selectExpr(
        f"{key}", f"CASE kind WHEN 1 THEN {time} - {width} WHEN 3 THEN _prev.t ELSE {time} END AS _at", f"CASE kind WHEN 0 THEN {ident} WHEN 1 THEN '' WHEN 2 THEN {ident} || '\\u0001' ELSE _prev.i || '\\u0001' END AS _tie",
        "kind", *[f"IF(kind = 0, {c}, NULL) AS {c}" for c in rows.columns if c not in (key, "is_anchor", "is_member")], *[f"{signed(sql)} AS _d_{name}" for name, sql in sums.items()], f"{distinct} AS _d_n_distinct",
    )
    run = with_running(events, [key], "_at", span, before={name: ("sum", f"_d_{name}") for name in (*sums, "n_distinct")}, tie="_tie").where("kind = 0")
    return run.select(*[c for c in rows.columns if c not in ("is_anchor", "is_member")], *sums, "n_distinct")


def with_ahead(rows: DataFrame, key: str, time: str, ident: str, other: str, width: int, sums: Mapping[str, str]) -> DataFrame:
    """The same as with_swept by frames that look ahead, less the rows of the same time that stand before by ident."""
    over = f"OVER (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN CURRENT ROW AND {width} FOLLOWING)"
    peers = f"OVER (PARTITION BY {key}, {time} ORDER BY {ident} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    mine = {name: f"IF(is_member, {sql}, NULL)" for name, sql in sums.items()}
    ahead = f"collect_list(IF(is_member AND {other} != '', named_struct('at', named_struct('t', {time}, 'i', {ident}), 'other', {other}), NULL)) {over} AS _ahead"
    run = rows.repartition(key).selectExpr("*", *[f"sum({sql}) {peers} AS _p_{name}" for name, sql in mine.items()]).selectExpr("*", *[f"sum({sql}) {over} AS _f_{name}" for name, sql in mine.items()], ahead).where("is_anchor")
    distinct = f"CAST(size(array_distinct(transform(filter(_ahead, x -> x.at >= named_struct('t', {time}, 'i', {ident})), x -> x.other))) AS BIGINT) AS n_distinct"
    return run.selectExpr(*[c for c in rows.columns if c not in ("is_anchor", "is_member")], *[f"coalesce(_f_{name}, 0) - coalesce(_p_{name}, 0) AS {name}" for name in sums], distinct)


def with_last(rows: DataFrame, marks: DataFrame, key: str, time: str, ident: str, width: int, span: int, hot: DataFrame | bool = True) -> DataFrame:
    """rows (key, time, ident) that have a mark (key, time, ident, mark: a struct that begins with time and ident) at or before
    them by (time, ident), at most width earlier, and the last such mark."""
    kind = marks.schema["mark"].dataType
    there = marks.select(key, time, F.col(ident).alias("_tie"), F.lit(None).cast(rows.schema[ident].dataType).alias(ident), "mark")
    asked = rows.join(marks.select(key).distinct(), key, "left_semi").select(key, time, F.concat(ident, F.lit("\u0001")).alias("_tie"), ident, F.lit(None).cast(kind).alias("mark"))
    run = with_running(there.unionByName(asked), [key], time, span, before={"last": ("max", "mark")}, tie="_tie", hot=hot)
    return run.where(F.col(ident).isNotNull() & (F.col(f"last.{time}") >= F.col(time) - width)).select(ident, "last")


def last_within(marks: DataFrame, rows: DataFrame, key: str, time: str, width: int, span: int, hot: DataFrame | bool = True) -> DataFrame:
    """marks plus last_time: the time of the last of the rows of the key that is at most width later than the mark."""
    ends = marks.withColumns({"_at": F.col(time) + width, "_t": F.lit(None).cast("long")})
    others = rows.join(marks.select(key).distinct(), key, "left_semi").select(key, F.col(time).alias("_at"), F.col(time).alias("_t"))
    run = with_running(ends.unionByName(others, allowMissingColumns=True), [key], "_at", span, at={"last_time": ("max", "_t")}, hot=hot)
    return run.where("_t IS NULL").select(*marks.columns, "last_time")
