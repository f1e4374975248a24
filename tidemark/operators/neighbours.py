"""Exact nearest neighbours among all rows, and local outlier factors from them.

Rows are dealt to cells around pivots. A row's neighbours in its own cell bound how far its true ones can be; it then visits
the other cells that reach into that distance, and no others. Cells are met in blocks of rows, so none has to fit a task.
Rows with equal vectors are one place, which is searched once: all its rows have the same candidates around them.
Several settings, each with points and candidates of its own, run through the same jobs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Rows for each pivot, pivots of a setting at most, rows of a group of cells, of queries that meet one, and of a step in a task.
CELL, MOST_PIVOTS, BLOCK, TURN, STEP = 1024, 1024, 16_384, 65_536, 256
NEAR = "setting int, id string, near array<struct<d: double, other: string, n: int>>"


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


@dataclass
class Cells:
    """Pivots of a setting, and how near and far from its pivot a cell's candidates lie."""

    pivots: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def reached(self, v: np.ndarray, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells' candidates may lie within a row's bound: they are between least and most from their pivot, and nearer to it
        than to any other."""
        d = distances(v, self.pivots)
        gap = np.maximum(self.least - d, d - self.most)
        mine = d[np.arange(len(v)), own][:, None]
        between = distances(self.pivots[own], self.pivots)
        side = np.divide(d * d - mine * mine, 2 * between, out=np.full(d.shape, -np.inf), where=between > 0)
        slack = 1e-6 * max(1.0, float(np.abs(v).max(initial=0)))
        out = (np.maximum(gap, side) <= bound[:, None] + slack) & (self.most >= self.least)
        out[np.arange(len(v)), own] = True
        return out


@dataclass
class Candidates:
    """Candidates of some cells, in the order of cells."""

    ids: pa.Array
    x: np.ndarray
    cell: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Candidates:
        cell = table["cell"].to_numpy()
        order = np.argsort(cell, kind="stable")
        return cls(table["id"].combine_chunks().take(pa.array(order)), vectors(table["v"])[order], cell[order], table["n"].to_numpy()[order])

    def __post_init__(self):
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        self.wide = np.concatenate([-2 * self.x, (self.x * self.x).sum(1)[:, None], np.ones((len(self.x), 1))], axis=1)
        self.names, self.first = np.unique(self.cell, return_index=True)
        self.last = np.append(self.first[1:], len(self.cell))
        self.scale = float(np.abs(self.x).max(initial=1.0))

    def rough(self, q: np.ndarray, part: slice) -> np.ndarray:
        """Squared distances, up to rounding."""
        return np.concatenate([q, np.ones((len(q), 1)), (q * q).sum(1)[:, None]], axis=1) @ self.wide[part].T

    def nearest(self, q: np.ndarray, own: np.ndarray, bound: np.ndarray, me: np.ndarray, held: np.ndarray, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, distance) of the k nearest of each row of q, by (distance, id), none farther than its bound, nor itself, and
        none where nearer ones and what the row itself holds are more than k."""
        slack = 1e-6 * max(self.scale, float(np.abs(q).max(initial=0)))
        open_ = cells.reached(q, own, bound)[:, self.names]
        rows, places = [], []
        for j in np.flatnonzero(open_.any(axis=0)).tolist():
            at = np.flatnonzero(open_[:, j])
            r, c = np.nonzero(self.rough(q[at], slice(self.first[j], self.last[j])) <= (np.maximum(bound[at] + slack, 0) ** 2)[:, None])
            rows.append(at[r])
            places.append(c + self.first[j])
        row, place = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, places))
        d = np.zeros(len(row))
        for i in range(0, len(row), 1 << 18):
            part = slice(i, i + (1 << 18))
            d[part] = np.sqrt(((self.x[place[part]] - q[row[part]]) ** 2).sum(axis=1))  # the same for a pair wherever it is met
        keep = (d <= bound[row]) & (place != me[row])
        row, place, d = row[keep], place[keep], d[keep]
        order = np.lexsort((self.rank[place], d, row))
        row, place, d = row[order], place[order], d[order]
        start, n = np.searchsorted(row, row), self.n[place]
        before = np.cumsum(n) - n
        new = np.append(True, (row[1:] != row[:-1]) | (d[1:] != d[:-1]))[: len(row)]
        nearer = before[np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))] - before[start] if len(row) else before
        keep = (np.arange(len(row)) - start < k) & (nearer + held[row] <= k)
        return row[keep], place[keep], d[keep]

    def bounds(self, q: np.ndarray, cell: int, k: int) -> np.ndarray:
        """An upper bound of the distance of the k-th nearest: that among the candidates of a cell, or else of all here."""
        j = int(np.searchsorted(self.names, cell))
        held = j < len(self.names) and self.names[j] == cell and self.last[j] - self.first[j] > k
        part = slice(self.first[j], self.last[j]) if held else slice(0, len(self.x))
        if part.stop - part.start <= k:
            return np.full(len(q), np.inf)
        # One more than k: the row itself may be among them.
        edge = np.partition(self.rough(q, part), k, axis=1)[:, k]
        return np.sqrt(np.maximum(edge, 0)) + 1e-6 * max(self.scale, float(np.abs(q).max(initial=0)))


def steps(cell: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of one cell at a time, STEP at most."""
    order = np.argsort(cell, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        for i in range(0, len(own), STEP):
            yield own[i : i + STEP]


def listed(setting: int, ids: pa.Array, candidates: Candidates, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    """A row for each query with what it has found."""
    row, place, d = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row.astype(np.int64), minlength=len(ids)))])
    near = pa.StructArray.from_arrays([pa.array(d[order].astype(float)), candidates.ids.take(pa.array(place[order].astype(np.int64))), pa.array(candidates.n[place[order].astype(np.int64)].astype(np.int32))], ["d", "other", "n"])
    return pa.table({"setting": pa.array([setting] * len(ids), pa.int32()), "id": ids, "near": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), near)})


def grouped(cells: dict[int, int], pivots: np.ndarray, size: int) -> list[list[int]]:
    """Cells (name: rows) in groups of near ones, of `size` rows at most unless a single cell has more."""
    names = sorted(cells)
    if len(names) == 1 or sum(cells.values()) <= size:
        return [names]
    p = pivots[names]
    order = sorted(names, key=lambda c: (pivots[c, int(np.ptp(p, axis=0).argmax())], c))
    upto = np.cumsum([cells[c] for c in order])
    cut = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(order) - 1)
    return grouped({c: cells[c] for c in order[:cut]}, pivots, size) + grouped({c: cells[c] for c in order[cut:]}, pivots, size)


def near_places(points: DataFrame, k: int) -> DataFrame:
    """(setting, id, near): for each point the k nearest candidates of its setting, itself left out, as (d, other) by distance,
    then id. points: setting, id (once a setting), candidate, v (doubles, as many everywhere). With n, the candidates that a point
    stands for, points are left out where nearer ones and its own are more than k, and n comes along."""
    spark = points.sparkSession
    sizes = {r["setting"]: r["n"] for r in points.groupBy("setting").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], f"{NEAR}, n int")
    # The points with the smallest hashes are pivots, so many that a cell holds some CELL rows.
    wanted = {s: min(MOST_PIVOTS, -(-n // CELL)) for s, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for s, n in wanted.items() for x in (s, min(1.0, (4 * n + 40) / sizes[s]))])[F.col("setting")]
    mixed = F.xxhash64("setting", "id")
    some = points.where((F.pmod(mixed, F.lit(1 << 30)) / float(1 << 30)) < share).select("setting", mixed.alias("h"), "v").collect()
    pivots = {s: np.array([r["v"] for r in sorted((r for r in some if r["setting"] == s), key=lambda r: r["h"])[:n]], dtype=float) for s, n in wanted.items()}
    pivots = {s: p if len(p) else np.zeros((1, 1)) for s, p in pivots.items()}
    held = spark.sparkContext.broadcast(pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            setting, v = b.column(0).to_numpy(), vectors(b.column(3)) if b.num_rows else np.zeros((0, 1))
            cell, d = np.zeros(len(v), np.int32), np.zeros(len(v))
            for s in np.unique(setting).tolist():
                own = setting == s
                far = distances(v[own], held.value[s])
                cell[own], d[own] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d)], [*b.schema.names, "cell", "away"])

    schema = "setting int, id string, candidate boolean, v array<double>, n int, cell int, away double"
    held_by = F.col("n").cast("int") if "n" in points.columns else F.lit(0)
    cells = materialize(points.select("setting", "id", "candidate", "v", held_by.alias("n")).mapInArrow(home, schema), "cells")
    inside = F.col("candidate")
    ranges = cells.groupBy("setting", "cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(inside, F.col("away"))).alias("most"), F.min(F.when(inside, F.col("away"))).alias("least")).collect()  # a row a pivot
    limits, groups, spread = {}, {}, []
    for s, p in pivots.items():
        own = {r["cell"]: r for r in ranges if r["setting"] == s}
        limits[s] = Cells(p, *(np.array([x if (x := own[c][name] if c in own else None) is not None else none for c in range(len(p))]) for name, none in (("least", np.inf), ("most", -np.inf))))
        groups[s] = [[] for _ in p]
        count = 0
        for some_cells in grouped({c: r["n"] for c, r in own.items()}, p, BLOCK):
            parts = -(-own[some_cells[0]]["n"] // BLOCK) if len(some_cells) == 1 else 1  # a cell of many rows is several groups
            for c in some_cells:
                groups[s][c] = list(range(count, count + parts))
                spread.append((s, c, count, parts))
            count += parts
    known = spark.sparkContext.broadcast((limits, groups))
    dealt = F.broadcast(spark.createDataFrame(spread, "setting int, cell int, first int, parts int"))  # a row a pivot
    rows = cells.join(dealt, ["setting", "cell"]).select("setting", "id", "candidate", "v", "n", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), "parts").cast("int")).alias("group"))

    def at_home(table: pa.Table) -> pa.Table:
        """What rows find in their own group."""
        s, q, cell, n = table["setting"][0].as_py(), vectors(table["v"]), table["cell"].to_numpy(), table["n"].to_numpy()
        inside = np.flatnonzero(table["candidate"].to_numpy())
        few = Candidates.of(table.take(pa.array(inside)))
        me = np.full(len(q), -1)
        me[inside[np.argsort(cell[inside], kind="stable")]] = np.arange(len(inside))
        found = []
        for own in steps(cell) if len(inside) else ():
            bound = np.where(n[own] > k, -1.0, few.bounds(q[own], int(cell[own[0]]), k))
            row, place, d = few.nearest(q[own], cell[own], bound, me[own], n[own], known.value[0][s], k)
            found.append((own[row], place, d))
        out = listed(s, table["id"].combine_chunks(), few, found)
        return out.append_column("v", table["v"]).append_column("n", table["n"]).append_column("cell", table["cell"]).append_column("group", table["group"])

    first = materialize(rows.groupBy("setting", "group").applyInArrow(at_home, f"{NEAR}, v array<double>, n int, cell int, group int"), "near-first")
    enough = (F.size("near") >= k) | (F.col("n") + F.aggregate("near", F.lit(0), lambda a, x: a + x["n"]) > k)
    bound = F.when(F.col("n") > k, -1.0).when(enough, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf")))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other groups that have cells within a row's bound."""
        for b in batches:
            setting, v = b.column(0).to_numpy(), vectors(b.column(2)) if b.num_rows else np.zeros((0, 1))
            cell, group, bound = (b.column(i).to_numpy() for i in (4, 5, 6))
            at, to = [], []
            for s in np.unique(setting).tolist():
                mine = np.flatnonzero(setting == s)
                limits, groups = known.value[0][s], known.value[1][s]
                open_ = limits.reached(v[mine], cell[mine], bound[mine])
                into = np.zeros((len(groups), 1 + max(g for of in groups for g in of)), bool)
                for c, of in enumerate(groups):
                    into[c, of] = True
                meets = (open_.astype(np.float32) @ into.astype(np.float32)) > 0
                meets[np.arange(len(mine)), group[mine]] = False
                meets[bound[mine] < 0] = False
                r, g = np.nonzero(meets)
                at.append(mine[r])
                to.append(g)
            at, to = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, to))
            some = pa.array(at)
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(some) for i in range(7)], pa.array(to.astype(np.int32))], ["setting", "id", "v", "n", "cell", "home", "bound", "group"])

    asked = first.select("setting", "id", "v", "n", "cell", "group", bound.alias("bound")).mapInArrow(visit, "setting int, id string, v array<double>, n int, cell int, home int, bound double, group int")
    asked = materialize(asked, "near-asked")
    turns = materialize(asked.groupBy("setting", "group").agg(F.ceil(F.count(F.lit(1)) / TURN).cast("int").alias("turns")), "near-turns")
    keys = ["setting", "group", "turn"]
    one = rows.where("candidate").join(F.broadcast(turns), ["setting", "group"]).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    two = asked.join(F.broadcast(turns), ["setting", "group"]).withColumn("turn", F.pmod("home", "turns"))

    def meet(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        """What rows of other groups find in a group."""
        few = Candidates.of(candidates)
        if not len(few.x) or not queries.num_rows:
            return listed(0, queries["id"].combine_chunks().slice(0, 0), few, [])
        s, q, cell, bound = queries["setting"][0].as_py(), vectors(queries["v"]), queries["cell"].to_numpy(), queries["bound"].to_numpy()
        found, n = [], queries["n"].to_numpy()
        for own in steps(cell):
            row, place, d = few.nearest(q[own], cell[own], bound[own], np.full(len(own), -1), n[own], known.value[0][s], k)
            found.append((own[row], place, d))
        return listed(s, queries["id"].combine_chunks(), few, found)

    second = one.select(*keys, "id", "v", "n", "cell").groupBy(*keys).cogroup(two.select(*keys, "id", "v", "n", "cell", "bound").groupBy(*keys)).applyInArrow(meet, NEAR)
    second = second.where(F.size("near") > 0).withColumn("n", F.lit(None).cast("int"))
    every = F.array_sort(F.flatten(F.collect_list("near")))
    return materialize(first.select("setting", "id", "near", "n").unionByName(second).groupBy("setting", "id").agg(F.slice(every, 1, k).alias("near"), F.max("n").alias("n")), "near")


def around_places(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(points as (setting, id, candidate, place), (setting, place, around)): around are the first k + 1 candidates by (d, id), as
    (d, id, place), those of the place itself among them. A place is named by its first candidate, or by its first row.

    A candidate that is among the first has no more places before its own than candidates, so the k nearest other places hold all.
    """
    key = ["setting", "v"]
    name = F.coalesce(F.min(F.when(F.col("candidate"), F.col("id"))), F.min("id"))
    # Of a place's candidates only the first k + 1 can be told of; each task keeps no more.
    order = Window.partitionBy(*key).orderBy("id")
    ids = points.where("candidate").select(*key, "id").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k + 1).groupBy(*key).agg(F.collect_list("id").alias("ids"))
    held = materialize(points.groupBy(*key).agg(name.alias("place"), F.bool_or("candidate").alias("candidate")).join(ids.hint("merge"), key, "left"), "places")
    members = points.hint("merge").join(held.select(*key, "place"), key).select("setting", "id", "candidate", "place")
    near = near_places(held.select("setting", F.col("place").alias("id"), "candidate", "v", F.when(F.col("ids").isNotNull(), F.size("ids")).otherwise(0).alias("n")), k)
    # Where no place holds several candidates, places are candidates.
    single = (F.col("n") <= 1) & F.forall("near", lambda x: x["n"] == 1)
    itself = F.when(F.col("n") == 1, F.array(F.struct(F.lit(0.0).alias("d"), "id", F.col("id").alias("place")))).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<d: DOUBLE, id: STRING, place: STRING>>)"))
    plain = F.concat(itself, F.transform("near", lambda x: F.struct(x["d"].alias("d"), x["other"].alias("id"), x["other"].alias("place"))))
    alone = near.where(single & ((F.col("n") == 1) | (F.size("near") > 0))).select("setting", F.col("id").alias("place"), F.slice(F.array_sort(plain), 1, k + 1).alias("around"))
    near = near.where(~single)
    told = held.where("candidate").select("setting", F.col("place").alias("at"), "ids")
    own = near.where("n > 0").select("setting", F.col("id").alias("place"), F.lit(0.0).alias("d"), F.col("id").alias("at"))
    others = near.select("setting", F.col("id").alias("place"), F.explode("near").alias("n")).select("setting", "place", "n.d", F.col("n.other").alias("at"))
    # A place is needed unless nearer ones hold k + 1 candidates.
    counted = own.unionByName(others).hint("merge").join(told.select("setting", "at", F.size("ids").alias("n")), ["setting", "at"])
    upto = F.sum("n").over(Window.partitionBy("setting", "place").orderBy("d"))
    needed = counted.withColumn("_nearer", upto - F.sum("n").over(Window.partitionBy("setting", "place", "d"))).where(F.col("_nearer") <= k)
    each = needed.select("setting", "place", "d", "at").hint("merge").join(told, ["setting", "at"]).select("setting", "place", "d", F.explode("ids").alias("id"), "at")
    around = each.groupBy("setting", "place").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", F.col("at").alias("place")))), 1, k + 1).alias("around"))
    return members, materialize(alone.unionByName(around), "around")


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """(setting, id, near): for each point the k nearest candidates of its setting, itself left out, as (d, other) by distance,
    then id. points: setting, id (once a setting), candidate, v (doubles, as many everywhere)."""
    members, around = around_places(points, k)
    others = members.hint("merge").join(around, ["setting", "place"]).where((F.size("around") > 1) | (F.col("around")[0]["id"] != F.col("id")))
    found = others.select("setting", "id", F.slice(F.filter("around", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return found.select("setting", "id", F.transform("near", lambda x: F.struct(x["d"].alias("d"), x["id"].alias("other"))).alias("near"))


def local_outlier_factors(points: DataFrame, k: int = 35) -> DataFrame:
    """(setting, id, factor) of the points that are no candidates: the mean density of a point's k nearest candidates over its
    own, where a density is one over the mean reach distance to the k nearest. Points without candidates are left out."""
    members, around = around_places(points, k)
    # All candidates of a place have the same distances and densities: the first of those around them is one of themselves.
    each = around.select("setting", "place", F.posexplode("around").alias("at", "n")).select("setting", "place", "at", "n.d", F.col("n.place").alias("other"))
    radius = around.select("setting", F.col("place").alias("other"), F.when(F.size("around") > 1, F.element_at("around", -1)["d"]).alias("radius"))
    reached = each.hint("merge").join(radius.where("radius IS NOT NULL"), ["setting", "other"]).withColumn("reach", F.greatest("d", "radius"))
    density = lambda rows: 1.0 / F.greatest(F.avg(F.when(rows, F.col("reach"))), F.lit(1e-12))
    some = lambda rows: F.count_if(rows) > 0
    inner, outer = F.col("at") > 0, F.col("at") < k
    found = reached.groupBy("setting", "place").agg(F.when(some(inner), density(inner)).alias("theirs"), F.when(some(outer), density(outer)).alias("own"))
    found = materialize(found, "densities")
    asked = materialize(members.where("NOT candidate").select("setting", "id", "place"), "asked")
    wanted = each.where(outer).hint("merge").join(asked.select("setting", "place").distinct(), ["setting", "place"], "left_semi")
    theirs = found.where("theirs IS NOT NULL").select("setting", F.col("place").alias("other"), "theirs")
    mean = wanted.hint("merge").join(theirs, ["setting", "other"]).groupBy("setting", "place").agg(F.avg("theirs").alias("around"))
    factor = mean.join(found.where("own IS NOT NULL"), ["setting", "place"]).select("setting", "place", (F.col("around") / F.col("own")).alias("factor"))
    return asked.hint("merge").join(factor, ["setting", "place"]).select("setting", "id", "factor")
