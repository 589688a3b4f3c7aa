"""K-means for many k at once: each round is one pass over the vectors that serves all k.

Vectors are stored once as sparse rows. A round gives every center the sum and number of its vectors, added up over the
cluster by k and center; what comes to the driver is the centers alone, as many as the sum of the k. The last pass
gives each k its cost and its simplified silhouette: how much nearer a vector is to its own center than to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

SEED = 42
#: Vectors that the first centers are chosen among, and rounds at most.
SAMPLE, ROUNDS = 1000, 20
#: Rows that are worked on at once.
ROWS = 256


def entries(vector: Column) -> Column:
    """at and x of what isn't zero in a vector; a sparse one is not written out."""
    plain = F.unwrap_udt(vector)
    at = F.when(plain["type"] == 0, plain["indices"]).when(F.size(plain["values"]) > 0, F.sequence(F.lit(0), F.size(plain["values"]) - 1))
    return F.filter(F.zip_with(F.coalesce(at, F.array().cast("array<int>")), plain["values"], lambda i, x: F.struct(i.alias("at"), x.alias("x"))), lambda p: p["x"] != 0)


def sparse_rows(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """at and x (places and values that aren't zero) of each vector, stored. There are as many parts as tasks that run at once,
    as each part sends all centers in each round."""
    plain = F.unwrap_udt(F.col(column))
    made = vectors.select(entries(F.col(column)).alias("_p"), F.coalesce(plain["size"], F.size(plain["values"])).alias("width"))
    stored = checkpointed(made.select(F.col("_p.at").alias("at"), F.col("_p.x").alias("x"), "width"))
    return stored.coalesce(max(2, vectors.sparkSession.sparkContext.defaultParallelism))


def dense(at: list, x: list, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    for i, (p, v) in enumerate(zip(at, x, strict=True)):
        out[i, p] = v
    return out


def first_centers(rows: DataFrame, ks: list[int], seed: int = SEED) -> dict[int, np.ndarray]:
    """For each k: of at most SAMPLE vectors by a hash, one after the other drawn by the squared distance to those drawn."""
    some = rows.orderBy(F.xxhash64(F.lit(seed), F.col("at"), F.col("x"))).limit(SAMPLE).collect()
    v = dense([r["at"] for r in some], [r["x"] for r in some], some[0]["width"])
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(v)))]
    far = ((v - v[chosen[0]]) ** 2).sum(1)
    while len(chosen) < max(ks):
        nxt = int(draw.choice(len(v), p=far / far.sum())) if far.sum() > 0 else int(draw.integers(len(v)))
        chosen.append(nxt)
        far = np.minimum(far, ((v - v[nxt]) ** 2).sum(1))
    return {k: v[chosen[:k]] for k in ks}


def distances(at: pa.Array, x: pa.Array, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances of sparse rows to centers; and the rows' entries as row, place, value."""
    sizes = np.diff(at.offsets.to_numpy())
    row, place, value = np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy(), x.flatten().to_numpy()
    whole = np.zeros((len(at), centers.shape[1]))
    whole[row, place] = value
    dot = whole @ centers.T
    own = np.bincount(row, weights=value**2, minlength=len(at))
    return np.maximum(own[:, None] - 2 * dot + (centers**2).sum(1), 0), row, place, value


def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS).combine_chunks() if hasattr(batch, "combine_chunks") else pa.RecordBatch.from_pydict(batch.slice(start, ROWS).to_pydict(), batch.schema)


def step(rows: DataFrame, centers: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """The centers after one round; a center without vectors stays."""
    ks, width = sorted(centers), next(iter(centers.values())).shape[1]
    known = rows.sparkSession.sparkContext.broadcast(centers)  # as many as the sum of the k

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(k * width) for k in ks}
        stacked = np.concatenate([known.value[k] for k in ks])
        counts = {k: np.zeros(k) for k in ks}
        for batch in batches(source):
            far, row, place, value = distances(batch.column("at"), batch.column("x"), stacked)
            start = 0
            for k in ks:
                own = far[:, start : start + k].argmin(1)
                np.add.at(sums[k], own[row] * width + place, value)
                counts[k] += np.bincount(own, minlength=k)
                start += k
        found = [(k, c, float(counts[k][c]), sums[k][c * width : (c + 1) * width].tobytes()) for k in ks for c in range(k) if counts[k][c]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], ["k", "c", "n", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, float) for s in table.column("s").to_pylist()], axis=0)
        return pa.table({"k": table.column("k")[:1], "c": table.column("c")[:1], "n": [sum(table.column("n").to_pylist())], "s": [total.tobytes()]})

    schema = "k int, c int, n double, s binary"
    out = {k: v.copy() for k, v in centers.items()}
    for r in rows.mapInArrow(run, schema).groupBy("k", "c").applyInArrow(add, schema).collect():
        out[r["k"]][r["c"]] = np.frombuffer(bytes(r["s"]), float) / r["n"]
    return out


def fit_all(rows: DataFrame, ks: list[int], seed: int = SEED, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Centers for each k, after rounds until none moves."""
    centers, moving = first_centers(rows, ks, seed), list(ks)
    for _ in range(rounds):
        new = step(rows, {k: centers[k] for k in moving})
        moving = [k for k in moving if np.abs(new[k] - centers[k]).max() > 1e-6]
        centers |= new
        if not moving:
            break
    return centers


def qualities(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """k, n, cost (sum of squared distances to the own center) and silhouette (simplified; 0 for equal distances)."""
    ks = sorted(centers)
    known = rows.sparkSession.sparkContext.broadcast(centers)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, stacked = np.zeros((len(ks), 3)), np.concatenate([known.value[k] for k in ks])
        for batch in batches(source):
            far = distances(batch.column("at"), batch.column("x"), stacked)[0]
            start = 0
            for i, k in enumerate(ks):
                near = np.sort(far[:, start : start + k], axis=1)[:, :2]
                a, b = np.sqrt(near[:, 0]), np.sqrt(near[:, -1])
                totals[i] += len(far), near[:, 0].sum(), np.divide(b - a, b, out=np.zeros_like(a), where=b > 0).sum()
                start += k
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), *(pa.array(c) for c in totals.T)], ["k", "n", "cost", "silhouette"])

    sums = rows.mapInArrow(run, "k int, n double, cost double, silhouette double").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("n", "cost", "silhouette")))
    return sums.select("k", F.col("n").cast("long").alias("n"), "cost", (F.col("silhouette") / F.greatest("n", F.lit(1.0))).alias("silhouette"))


def elbow(found: list[tuple[int, float, float]]) -> int:
    """Of (k, cost, silhouette) the k furthest from the chord of the costs; where these lie on it, that of the best silhouette."""
    found = sorted(found)
    x, cost = np.linspace(0, 1, len(found)), np.array([c for _, c, _ in found])
    y = (cost - cost.min()) / (np.ptp(cost) or 1)
    off = np.abs(x + y - 1)
    if len(found) < 3 or np.ptp(cost) == 0 or off.max() < 1e-3:
        return max(found, key=lambda f: (f[2], -f[0]))[0]
    return found[int(off.argmax())][0]
