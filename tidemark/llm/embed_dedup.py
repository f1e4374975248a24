"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative a group.

Centroids are fitted on a sample; every vector is assigned. A pair above the threshold can lie in two cells, so a vector
may be a guest in each cell whose border with its own is as near as two linked vectors can be apart. Guests come as short
codes first, coordinates along a few axes of a rotation: no two vectors are nearer than their codes, so a guest whose code
is near no host's stays out, no link is lost, and whole vectors travel for hosts and the few guests that are left. A cell
of any size is compared block by block, and what leaves a block is a count per vector and a spanning star per group, never
its pairs. Equal vectors are collapsed first and count with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .mixing import hash60
from .vectors import matrix, usable

#: There are as many cells as the root of the number of vectors over CELL_ROOT; centroids are fitted on SAMPLE vectors, and
#: at least SAMPLE_PER_CELL for each of them.
CELL_ROOT, SAMPLE, SAMPLE_PER_CELL = 9, 16_384, 32
#: Axes of a code; rows of one block of codes, and of one block of vectors.
AXES, CODE_BLOCK, BLOCK = 16, 8192, 2048


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; a centroid that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centroids)
    return centroids


def code_axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal axes along which unit vectors differ most."""
    values, axes = np.linalg.eigh((x.T @ x) / max(1, len(x)))
    return axes[:, np.argsort(-values)[:AXES]]


def codes_of(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return np.rint(x @ axes * 127).astype(np.int8)


def near_codes(guests: np.ndarray, hosts: np.ndarray, reach: float) -> np.ndarray:
    """Whether each guest's code allows for a host within reach; rounding can bring codes apart by half a step each."""
    a, b = guests.astype(np.float32), hosts.astype(np.float32)
    most = 127 * reach + np.sqrt(a.shape[1]) + 1e-3
    apart = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return apart.min(axis=1, initial=np.inf) <= most * most


def cells_of(x: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is own) for the own and guest cells of unit vectors: a vector within reach of one in another cell is
    within reach of the border, the plane that halves the way between the two centroids."""
    sims = x @ centroids.T
    own = sims.argmax(axis=1)
    apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
    near = sims[np.arange(len(x)), own][:, None] - sims <= reach * apart[own] + 1e-9
    near[np.arange(len(x)), own] = True
    row, cell = np.nonzero(near)
    return row, cell, own[row] == cell


def compare(hosts: np.ndarray, host_rep: np.ndarray, others: np.ndarray, other_rep: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each host to the others, by weight and without itself; and the smallest rep that each host and each
    other reaches over links between these two blocks."""
    linked = hosts @ others.T >= threshold
    same = host_rep[:, None] == other_rep[None, :]
    counts = (linked & ~same) @ weight
    linked |= same
    top = np.iinfo(np.int64).max
    a, b = host_rep.copy(), other_rep.copy()
    while True:
        a2 = np.minimum(a, np.where(linked, b[None, :], top).min(axis=1))
        b2 = np.minimum(b, np.where(linked, a2[:, None], top).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return counts, a, b
        a, b = a2, b2


def embedding_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept. Vectors are compared if their labels are equal and not null
    and they have as many components.

    Null, zero or non-finite vectors, null labels: no links, a component of their own. Null ids: no links, component null,
    kept true. Rows with equal vectors link; a row that repeats an id counts like any other. Empty table: empty result.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    live = src.where(usable(F.col("v")) & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("dim", F.size("v"))
    distinct = materialize(live.groupBy("label", "dim", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vec-distinct")
    dims = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    fitted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim, n in dims.items():
        cells = max(1, round(n**0.5 / CELL_ROOT))
        size = max(SAMPLE, SAMPLE_PER_CELL * cells)
        few = distinct.where(F.col("dim") == dim).select("v", hash60(F.col("rep")).alias("h")).where(F.col("h") < int(min(1.0, 1.2 * size / n) * 2**60)).limit(size)
        sample = unit(np.array([r["v"] for r in few.collect()], dtype=np.float64).reshape(-1, dim))
        fitted[dim] = spherical_kmeans(sample, cells), code_axes(sample)
    reach = float(np.sqrt(2 - 2 * threshold))
    held = vectors.sparkSession.sparkContext.broadcast(fitted)

    def assigned(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        """Hosts with their whole vectors, or all rows of cells with their codes."""
        for batch in batches:
            dim_of = batch.column(1).to_numpy()
            for dim in np.unique(dim_of).tolist():
                centroids, axes = held.value[dim]
                part = batch.filter(pa.array(dim_of == dim))
                for k in range(0, part.num_rows, 4096):
                    some = part.slice(k, 4096)
                    x = unit(matrix(some.column(2), dim))
                    if whole:
                        cell = (x @ centroids.T).argmax(axis=1)
                        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cell.astype(np.int32)), pa.array(np.ones(len(cell), bool))], [*batch.schema.names, "cell", "host"])
                        continue
                    row, cell, own = cells_of(x, centroids, reach)
                    codes = [c.tobytes() for c in codes_of(x, axes)[row]]
                    took = some.select(["label", "dim", "rep"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(codes, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(own)], ["label", "dim", "rep", "v", "cell", "host"])

    kind = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}
    narrow = distinct.select("label", "dim", "v", "rep", "n")
    keys = ["label", "dim", "cell"]

    def dealt(rows: DataFrame, others: Column, size: int, *columns: str) -> DataFrame:
        """Hosts (left) and others of each cell, blocked apart: each block of hosts meets each block of others."""
        many = lambda n: F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
        sizes = rows.groupBy(*keys).agg(many(F.count_if("host")).alias("hosts"), many(F.count_if(others)).alias("others"))
        rows = rows.join(materialize(sizes, "vec-cells"), keys)
        block = lambda n, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cols = [*keys, "i", "j", "v", "rep", *columns]
        lefts = rows.where("host").withColumns({"i": block("hosts", 0), "j": every("others")}).select(*cols, F.lit(True).alias("left"))
        rights = rows.where(others).withColumns({"j": block("others", 1), "i": every("hosts")}).select(*cols, F.lit(False).alias("left"))
        return lefts.unionByName(rights).groupBy(*keys, "i", "j")

    def admit(group: pa.Table) -> pa.Table:
        left = group["left"].to_numpy()
        rep, codes = group["rep"].to_numpy()[~left], np.frombuffer(b"".join(group["v"].to_pylist()), np.int8).reshape(len(left), -1)
        near = near_codes(codes[~left], codes[left], reach)
        return pa.table({"guest": rep[near], "cell": pa.array(np.full(near.sum(), group["cell"][0].as_py()), pa.int32())})

    placed = materialize(narrow.mapInArrow(lambda b: assigned(b, False), f"label {kind['label']}, dim int, rep long, v binary, cell int, host boolean"), "vec-codes")
    guests = materialize(dealt(placed, ~F.col("host"), CODE_BLOCK).applyInArrow(admit, "guest long, cell int").distinct(), "vec-guests")
    hosts = narrow.mapInArrow(lambda b: assigned(b, True), f"label {kind['label']}, dim int, v {kind['v']}, rep long, n long, cell int, host boolean")
    came = narrow.join(guests, F.col("rep") == F.col("guest")).withColumn("host", F.lit(False)).select(*hosts.columns)
    placed = materialize(hosts.unionByName(came), "vec-placed")

    def meet(group: pa.Table) -> pa.Table:
        dim = group["dim"][0].as_py()
        left = group["left"].to_numpy()
        right = ~left
        x, rep, n = unit(matrix(group["v"], dim)), group["rep"].to_numpy(), group["n"].to_numpy()
        if not left.any() or not right.any():
            return pa.table({"rep": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        counts, a, b = compare(x[left], rep[left], x[right], rep[right], n[right], threshold)
        moved = b != rep[right]
        return pa.table({"rep": np.concatenate([rep[left], rep[right][moved]]), "links": np.concatenate([counts, np.zeros(moved.sum(), np.int64)]).astype(np.int64), "root": np.concatenate([a, b[moved]])})

    met = materialize(dealt(placed, F.lit(True), BLOCK, "n").applyInArrow(meet, "rep long, links long, root long"), "vec-met")
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = materialize(connected_components(met.where("rep != root").select(F.col("rep").alias("a"), F.col("root").alias("b"))), "vec-parts")
    known = distinct.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    known = materialize(known.select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "vec-known")
    # Only rows whose vector has links at all need the lookup, but which these are only the join tells.
    out = src.join(known, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
