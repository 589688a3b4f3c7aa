"""Exact neighbours within a distance, and clusters by density from them.

Points are dealt to the cell of their nearest pivot and, in it, to rings as wide as the distance by how far they are
from the pivot. By the triangle inequality a neighbour of a point within eps lies in a cell whose pivot is at most
2 eps further away than the nearest one, and there in the same ring or one next to it; so a point visits these rings
and meets all its neighbours, and every pair once. Rings with many points are cut into tiles of BLOCK by BLOCK points.

A tile doesn't give its pairs, of which a dense group has very many. It gives each visitor its number of neighbours,
and, once the core points are known, edges of a spanning forest of the core points it has linked: no more rows than it
has points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots, and points along each side of a tile.
PIVOTS, BLOCK = 128, 2048
#: Squares that differ by less than this share of their terms are worked out again from the differences.
DOUBT = 1e-9


def choose_pivots(points: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most `pivots` points chosen by a hash; any choice gives the same neighbours."""
    return np.array([row["v"] for row in points.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()], float).reshape(-1, len(points.select("v").first()["v"]) if not points.isEmpty() else 0)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs of rows are within eps; pairs in doubt are told by their differences."""
    found = squares(a, b)
    slack = DOUBT * ((a**2).sum(1)[:, None] + (b**2).sum(1) + eps * eps)
    out = found <= eps * eps
    i, j = np.nonzero(np.abs(found - eps * eps) <= slack)
    for first in range(0, len(i), 1 << 16):
        p, q = i[first : first + (1 << 16)], j[first : first + (1 << 16)]
        out[p, q] = np.sqrt(((a[p] - b[q]) ** 2).sum(1)) <= eps
    return out


def visits(points: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """id, core, v, own, cell, ring: each point once where it lives (own) and wherever its neighbours may live."""
    known = points.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                if not batch.num_rows:
                    continue
                v = matrix(batch.column("v"))
                far = np.sqrt(np.maximum(squares(v, known.value), 0))
                slack = 1e-6 * (1 + far.max(1)) + DOUBT
                own = far.argmin(1)
                row, cell = np.nonzero(far <= (far[np.arange(len(v)), own] + 2 * eps + 2 * slack)[:, None])
                d = far[row, cell]
                low, high = np.floor((d - eps - slack[row]) / eps), np.floor((d + eps + slack[row]) / eps)
                n = (high - low + 1).astype(int)
                at = np.repeat(np.arange(len(row)), n)
                ring = (np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int64)
                lives = np.floor(far[np.arange(len(v)), own] / eps).astype(np.int64)
                rows = np.concatenate([np.arange(len(v)), row[at]])
                kept = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [kept.column("id"), kept.column("core"), kept.column("v"), pa.array(np.arange(len(rows)) < len(v)), pa.array(np.concatenate([own, cell[at]]).astype(np.int64)), pa.array(np.concatenate([lives, ring]))],
                    ["id", "core", "v", "own", "cell", "ring"],
                )

    kind = dict(points.dtypes)["id"]
    return points.select("id", "core", "v").mapInArrow(run, f"id {kind}, core boolean, v array<double>, own boolean, cell long, ring long")


def tiles(visitors: DataFrame, work: Callable, schema: str, block: int = BLOCK) -> DataFrame:
    """work(visitors, dwellers) for every tile of every ring in which points live."""
    sizes = visitors.groupBy("cell", "ring").agg(F.ceil(F.count_if("own") / block).alias("m"), F.ceil(F.count_if(~F.col("own")) / block).alias("r")).where("m > 0")
    spread = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    placed = visitors.join(sizes, ["cell", "ring"])
    side = placed.withColumn("mine", F.when(F.col("own"), spread("m")).otherwise(spread("r"))).withColumn("other", F.explode(F.when(F.col("own"), every("r")).otherwise(every("m"))))
    keyed = side.withColumn("a", F.when(F.col("own"), F.col("mine")).otherwise(F.col("other"))).withColumn("b", F.when(F.col("own"), F.col("other")).otherwise(F.col("mine")))

    def run(rows: pa.Table) -> pa.Table:
        own = rows.column("own").combine_chunks()
        return work(rows.filter(pa.compute.invert(own)), rows.filter(own))

    return keyed.select("id", "core", "v", "own", "cell", "ring", "a", "b").groupBy("cell", "ring", "a", "b").applyInArrow(run, schema)


def near_counts(points: DataFrame, pivots: np.ndarray, eps: float, block: int = BLOCK) -> DataFrame:
    """id, n: how many points, itself included, are within eps of each."""
    kind = dict(points.dtypes)["id"]

    def count(visitors: pa.Table, dwellers: pa.Table) -> pa.Table:
        n = within(matrix(visitors.column("v").combine_chunks()), matrix(dwellers.column("v").combine_chunks()), eps).sum(1) if len(visitors) and len(dwellers) else np.zeros(len(visitors), int)
        return pa.table({"id": visitors.column("id"), "n": pa.array(n.astype(np.int64))})

    return tiles(visits(points, pivots, eps), count, f"id {kind}, n long", block).groupBy("id").agg(F.sum("n").alias("n"))


def core_edges(points: DataFrame, pivots: np.ndarray, eps: float, block: int = BLOCK) -> DataFrame:
    """id, to, core: edges that join the core points of each tile, and of other points to a core point of each group near."""
    kind = dict(points.dtypes)["id"]

    def join(visitors: pa.Table, dwellers: pa.Table) -> pa.Table:
        dwellers = dwellers.filter(dwellers.column("core"))
        if not len(visitors) or not len(dwellers):
            none = pa.array([], visitors.schema.field("id").type)
            return pa.table({"id": none, "to": none, "core": pa.array([], pa.bool_())})
        near = within(matrix(visitors.column("v").combine_chunks()), matrix(dwellers.column("v").combine_chunks()), eps)
        up = np.arange(len(dwellers))

        def roots(i: np.ndarray) -> np.ndarray:
            while True:
                above = up[up[i]]
                if (above == up[i]).all():
                    return above
                up[i] = above

        core = np.asarray(visitors.column("core").combine_chunks().to_numpy(zero_copy_only=False), bool)
        met = [np.flatnonzero(row) for row in near]
        for k in np.flatnonzero(core):
            if len(met[k]):
                found = roots(met[k])
                up[found] = up[met[k]] = found.min()
        top = roots(np.arange(len(dwellers)))
        pairs = [(k, np.unique(top[met[k]])) for k in range(len(met)) if len(met[k])]
        who = np.repeat([k for k, _ in pairs], [len(t) for _, t in pairs]).astype(int)
        to = np.concatenate([t for _, t in pairs]).astype(int) if pairs else np.zeros(0, int)
        below = np.flatnonzero(top != np.arange(len(dwellers)))
        ids = pa.concat_arrays([visitors.column("id").combine_chunks().take(pa.array(who)), dwellers.column("id").combine_chunks().take(pa.array(below))])
        tops = dwellers.column("id").combine_chunks().take(pa.array(np.concatenate([to, top[below]])))
        return pa.table({"id": ids, "to": tops, "core": pa.array(np.concatenate([core[who], np.ones(len(below), bool)]))})

    return tiles(visits(points, pivots, eps), join, f"id {kind}, to {kind}, core boolean", block)
