"""Nearest neighbours by a permutation index.

A vector is represented by its PREFIX nearest pivots in order. Shards of the table keep pivot inverted files:
for each pivot, the vectors that have it in their prefix and at which place. A query reads the files of its own
pivots and sums up the footrule distance of both orders (a pivot missing from a prefix counts as at its end). Orders
tell directions only, and the measure is the inner product; so what the orders agree in is multiplied by the norm of
the vector, and the RERANK best of each shard by this are ranked again by the exact inner product. Copies of a vector within a shard
share one entry, so a large group of them can't push others out. Pivots are a bounded sample; every row is
indexed, and every query meets every shard.

Defined results: vectors that are null, zero, of another length than the most common one, or that hold null or
non-finite components take no part, nor do rows without an id; rows that repeat an id count once; ties go to the
smaller id; fewer candidates than asked for give all of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

PIVOTS, PREFIX, RERANK = 512, 64, 1024
#: What orders that have nothing in common agree in, beside 2 * (1 + 2 + ... + PREFIX) for equal ones.
APART = 500
#: Vectors of a shard and queries of a block, about.
SHARD, BLOCK = 8192, 4096


def usable(vector: str, length: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) == length) & ~bad & F.exists(vector, lambda x: x != 0)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The pivots of largest inner product with unit pivots, nearest first."""
    near = vectors @ pivots.T
    prefix = min(prefix, len(pivots))
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix]
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1).astype(np.int16)


class PivotFiles:
    """The inverted files of one shard; vectors and prefixes of distinct vectors."""

    def __init__(self, vectors: np.ndarray, prefixes: np.ndarray, pivots: int):
        n, self.width = prefixes.shape
        self.vectors, self.norms = vectors, np.linalg.norm(vectors, axis=1)
        flat = prefixes.reshape(-1).astype(np.int64)
        order = np.argsort(flat, kind="stable")
        self.of = (order // self.width).astype(np.int64)
        self.place = (order % self.width).astype(np.int64)
        self.begin = np.searchsorted(flat[order], np.arange(pivots + 1))

    def candidates(self, prefix: np.ndarray, most: int) -> np.ndarray:
        """The entries, at most `most`, that are best by footrule distance to the prefix and norm."""
        parts = [np.arange(self.begin[p], self.begin[p + 1]) for p in prefix]
        at = np.concatenate(parts)
        own = np.repeat(np.arange(self.width), [len(x) for x in parts])
        # both distances to the end, less the distance of the two places: what a common pivot saves
        saved = np.bincount(self.of[at], weights=2 * (self.width - np.maximum(own, self.place[at])), minlength=len(self.vectors))
        if len(saved) <= most:
            return np.arange(len(saved))
        return np.argpartition(-(saved + APART) * self.norms, most)[:most]


def search_shard(shard: pa.Table, asked: pa.Table, pivots: int, k: int, rerank: int) -> tuple[list, list, list]:
    ids = shard.column("vec_id").to_numpy()
    vectors = np.frombuffer(b"".join(shard.column("vector").to_pylist()), np.float64).reshape(len(ids), -1)
    prefixes = np.frombuffer(b"".join(shard.column("prefix").to_pylist()), np.int16).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    ids, vectors, prefixes = ids[order], np.ascontiguousarray(vectors[order]), prefixes[order]
    _, pick, group = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).reshape(-1), return_index=True, return_inverse=True)
    by_group = np.argsort(group, kind="stable")  # ids stay in order within a group
    begin = np.searchsorted(group[by_group], np.arange(len(pick) + 1))
    files = PivotFiles(vectors[pick], prefixes[pick], pivots)
    out: tuple[list, list, list] = ([], [], [])
    for query, raw, prefix in zip(asked.column("vec_id").to_pylist(), asked.column("vector").to_pylist(), asked.column("prefix").to_pylist(), strict=True):
        near = files.candidates(np.frombuffer(prefix, np.int16), rerank)
        score = np.sum(files.vectors[near] * np.frombuffer(raw, np.float64), axis=1)
        best = np.lexsort((ids[pick[near]], -score))[: k + 1]
        members = [by_group[begin[g] : min(begin[g + 1], begin[g] + k + 1)] for g in near[best]]
        found = ids[np.concatenate(members)]
        scores = np.repeat(score[best], [len(x) for x in members])
        others = found != query
        found, scores = found[others], scores[others]
        top = np.lexsort((found, -scores))[:k]
        out[0].append(np.full(len(top), query)), out[1].append(found[top]), out[2].append(scores[top])
    return out


def nearest(table: DataFrame, queries: Column, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, rerank: int = RERANK, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows to each row for which `queries` holds."""
    spark = table.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = table.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asked"))
    common = rows.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = rows.where(usable("vector", common["n"]))
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * pivots).select("vector").toArrow()
    some = np.unique(np.array(sample.column("vector").to_pylist(), np.float64).reshape(-1, common["n"]), axis=0)
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = some[np.random.default_rng(7).permutation(len(some))[:pivots]]
    some = spark.sparkContext.broadcast(some / np.linalg.norm(some, axis=1, keepdims=True))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1) + 0.0
            prefixes = nearest_pivots(vectors, some.value, prefix)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("asked"), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([p.tobytes() for p in prefixes], pa.binary())], ["vec_id", "asked", "vector", "prefix"])

    coded = good.mapInArrow(encode, "vec_id long, asked boolean, vector binary, prefix binary")
    stored = materialise(coded.groupBy("vec_id").agg(F.min(F.struct("vector", "prefix", "asked")).alias("_row")).select("vec_id", "_row.*"))
    count = stored.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    shards, blocks = count["n"] // SHARD + 1, count["q"] // BLOCK + 1
    mine = stored.select("vec_id", "vector", "prefix", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    theirs = stored.where("asked").select("vec_id", "vector", "prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("_shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("_block"))

    def search(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = search_shard(shard, asked, len(some.value), k, rerank)
        return pa.table({name: pa.array(np.concatenate(x)) for name, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    found = mine.groupBy("_shard", "_block").cogroup(theirs.groupBy("_shard", "_block")).applyInArrow(search, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(table: DataFrame) -> DataFrame:
    """Rows whose id is divisible by 20 against all rows."""
    return nearest(table, F.col("vec_id") % 20 == 0)
