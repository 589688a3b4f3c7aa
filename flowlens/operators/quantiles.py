"""Exact percentiles of groups of any size.

Values are counted first, by group and value, so that equal ones are one row and a group with most of the rows lies in
many tasks. In a group of very many values a rank is narrowed down in three steps, each a grouped count: by a coarse bucket that grows with the logarithm of the value, by an even part of that bucket's range,
and by value. What is put in order in one task is the buckets of a group, the parts of a bucket, the values of a part or
of a small group, and never the values of a large group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: Different values of a group that are put in order at once.
MOST = 100_000
#: Coarse buckets of each doubling of the value, and parts of a bucket.
STEPS, PARTS = 64, 4096
#: Beyond the buckets of all finite values.
OUTSIDE = 1 << 20


def _bucket(value: Column) -> Column:
    """Never falls as the value grows; infinite values have buckets of their own."""
    place = F.log2(F.abs(value) + 1) * STEPS
    size = F.when(F.abs(value) == float("inf"), OUTSIDE).otherwise(F.floor(F.least(place, F.lit(OUTSIDE - 1.0)))).cast("long")
    return F.when(value < 0, -size).otherwise(size)


def _part(value: Column) -> Column:
    """The even part of the bucket's range `_low` to `_high` that a value is in."""
    wide = F.col("_high") - F.col("_low")
    return F.when((wide > 0) & (wide < float("inf")), F.floor((value - F.col("_low")) / wide * PARTS).cast("long")).otherwise(F.lit(0).cast("long"))


def _same(keys: list[str]) -> Column:
    """That `a` and `b` have equal keys, null ones included."""
    return reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys), F.lit(True))


def _found(rows: DataFrame, keys: list[str], by: str, sought: DataFrame | Callable[[Column], Column], kept: list[str]) -> DataFrame:
    """For each rank sought among the rows of its keys the row in which it falls, and the rank among that row's own."""
    within = Window.partitionBy(*keys).orderBy(by)
    placed = rows.withColumn("_upto", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    if callable(sought):
        everything = Window.partitionBy(*keys)
        placed = placed.withColumn("_all", F.sum("_n").over(everything)).withColumn("_r", F.explode(sought(F.col("_all"))))
        hits, rank = placed.select("*", F.col("_r.at").alias("_at"), F.col("_r.rank").alias("_rank")), F.col("_rank")
    else:
        hits = placed.alias("a").join(sought.alias("b"), _same(keys)).select("a.*", "b._at", "b._rank")
        rank = F.col("_rank")
    return hits.where((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n"))).select(*keys, *kept, "_at", (rank - F.col("_upto") + F.col("_n")).alias("_rank"))


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, _v and how often it occurs (_n), stored: all numbers of the groups come from it. Nulls and NaN are left out."""
    keyed = df.select(*keys, F.lit(0).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    return checkpointed(keyed.groupBy(*keys, "_g", "_v").agg(F.count("*").alias("_n")))


def moments(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, mean, std (of a sample; 0 for one value), min, max of counted values."""
    v, n = F.col("_v"), F.col("_n")
    first = counts.groupBy(*keys, "_g").agg(F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
    wide = counts.alias("a").join(first.alias("b"), _same([*keys, "_g"])).select("a.*", "b.mean")
    spread = wide.groupBy(*keys, "_g").agg(F.sum((v - F.col("mean")) ** 2 * n).alias("_s"))
    joined = first.alias("a").join(spread.alias("b"), _same([*keys, "_g"]))
    std = F.when(F.col("a.n") > 1, F.sqrt(F.col("b._s") / F.greatest(F.col("a.n") - 1, F.lit(1)))).otherwise(0.0)
    return joined.select(*(F.col(f"a.{k}") for k in keys), "a.n", "a.mean", std.alias("std"), "a.min", "a.max")


def _narrowed(counts: DataFrame, own: list[str], ranks: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The values at the ranks and the totals of groups of any size, in three steps."""
    counts = counts.withColumn("_b", _bucket(F.col("_v")))
    coarse = counts.groupBy(*own, "_b").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    first = _found(coarse, own, "_b", ranks, ["_b", "_low", "_high", "_all"])
    bounds = first.select(*own, "_b", "_low", "_high").distinct()
    inside = counts.alias("a").join(bounds.alias("b"), _same([*own, "_b"])).select("a.*", "b._low", "b._high").withColumn("_c", _part(F.col("_v")))
    fine = inside.groupBy(*own, "_b", "_c").agg(F.sum("_n").alias("_n"))
    second = _found(fine, [*own, "_b"], "_c", first.select(*own, "_b", "_at", "_rank"), ["_c"])
    parts = second.select(*own, "_b", "_c").distinct()
    values = inside.alias("a").join(parts.alias("b"), _same([*own, "_b", "_c"])).select("a.*")
    third = _found(values, [*own, "_b", "_c"], "_v", second, ["_v"])
    totals = first.select(*own, "_at", "_all")
    return third.alias("a").join(totals.alias("b"), _same([*own, "_at"])).select(*(F.col(f"a.{k}") for k in own), "a._at", "a._v", "b._all")


def percentiles_of(counts: DataFrame, keys: list[str], shares: list[float], to: str = "percentiles", most: int = MOST) -> DataFrame:
    """keys and `to`: the percentiles at the shares of counted values, interpolated between neighbours. Groups of up to
    `most` different values are put in order as they are, others are narrowed down."""
    own = [*keys, "_g"]
    edges = [(2 * i + k, share, edge) for i, share in enumerate(shares) for k, edge in enumerate((F.floor, F.ceil))]
    ranks = lambda n: F.array(*(F.struct(F.lit(at).alias("at"), edge((n - 1) * share).cast("long").alias("rank")) for at, share, edge in edges))
    sizes = counts.groupBy(*own).agg(F.count("*").alias("_d"))
    if (sizes.agg(F.max("_d")).first()[0] or 0) <= most:
        found = _found(counts, own, "_v", ranks, ["_v", "_all"]).select(*own, "_at", "_v", "_all")
    else:
        large = sizes.where(F.col("_d") > most)
        split = lambda how: counts.alias("a").join(large.alias("b"), _same(own), how).select("a.*")
        found = _found(split("left_anti"), own, "_v", ranks, ["_v", "_all"]).select(*own, "_at", "_v", "_all").union(_narrowed(split("left_semi"), own, ranks))
    whole = found.groupBy(*own).agg(F.first("_all").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"))

    def between(i: int, share: float) -> Column:
        at = (F.col("_all") - 1) * share
        low, high = F.floor(at), F.ceil(at)
        a, b = F.col("_m")[2 * i], F.col("_m")[2 * i + 1]
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    return whole.select(*keys, F.array(*(between(i, share) for i, share in enumerate(shares))).alias(to))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], to: str = "percentiles", most: int = MOST) -> DataFrame:
    """percentiles_of() the values of a table; null keys are a group."""
    return percentiles_of(value_counts(df, keys, value), keys, shares, to, most)


def with_percentiles(grouped: DataFrame, counts: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """grouped with a column for each share, of the percentiles of counted values; keys may be none, for one row of totals."""
    found = percentiles_of(counts, keys, list(shares.values()), "_p")
    return grouped.alias("a").join(found.alias("b"), _same(keys), "left").select("a.*", *(F.get("b._p", F.lit(i)).alias(name) for i, name in enumerate(shares)))


def sketched(value: Column, share: float | list[float], accuracy: int) -> Column:
    """The percentile with a relative error in rank of one in `accuracy`, from a sketch of bounded size."""
    at = F.array(*map(F.lit, share)) if isinstance(share, list) else F.lit(share)
    return F.percentile_approx(value, at, accuracy)
