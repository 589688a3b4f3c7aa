"""Percentiles against those of sorted lists, on values of all sizes, and the plan of a hot group."""

import random

import numpy as np
import pytest

from flowlens.operators import log, quantiles


@pytest.mark.parametrize("most", [100_000, 0, 20])
def test_same_as_sorted(spark, most):
    draw = random.Random(3)
    groups = {
        "one": [5.0], "two": [1.0, 2.0], "ties": [3.0] * 50 + [4.0], "wide": [draw.uniform(-1, 1) * 10 ** draw.randrange(-300, 300) for _ in range(500)], "near": [1e9 + i * 1e-6 for i in range(999)],
        "whole": [float(draw.randrange(100)) for _ in range(1000)], "below": [-draw.expovariate(1) for _ in range(777)], "ends": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")], None: [draw.random() for _ in range(10)],
        "tiny": [draw.random() * 1e-12 for _ in range(300)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("one", None), ("two", float("nan")), ("none", None)]
    draw.shuffle(rows)
    shares = [0.0, 0.1, 0.5, 0.85, 0.95, 1.0]
    got = {r["k"]: r["percentiles"] for r in quantiles.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", shares, most=most).collect()}
    assert set(got) == set(groups)
    for k, values in groups.items():
        for share, found in zip(shares, got[k], strict=True):
            ordered = sorted(values)
            at = (len(ordered) - 1) * share
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high
            assert found == want or abs(found - want) <= 1e-12 * max(abs(want), 1e-300), (k, share, found, want)


def test_moments(spark):
    draw = random.Random(8)
    rows = [(k, round(1e6 + draw.random(), 2)) for k in "ab" for _ in range(500)] + [("one", 4.0), (None, 1.0), (None, 3.0)]
    got = {r["k"]: r for r in quantiles.moments(quantiles.value_counts(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), ["k"]).collect()}
    for k in ("a", "b", "one", None):
        v = [x for g, x in rows if g == k]
        want = (len(v), np.mean(v), np.std(v, ddof=1) if len(v) > 1 else 0.0, min(v), max(v))
        assert np.allclose([got[k][c] for c in ("n", "mean", "std", "min", "max")], want, rtol=1e-9)


def test_whole_table_and_empty(spark):
    numbers = spark.range(1001).selectExpr("cast(id as double) as v")
    assert quantiles.percentiles(numbers, [], "v", [0.5, 0.25]).first()["percentiles"] == [500.0, 250.0]
    assert quantiles.percentiles(numbers.limit(0), [], "v", [0.5]).count() == 0
    empty = log.case_duration_summary(spark.createDataFrame([], "case_id string, activity string, ts timestamp, event_id long")).first()
    assert empty["n_cases"] == 0 and empty["median_hours"] is None


def test_hot_group_is_split(spark):
    """Nearly all rows in one group: no task puts the values of a group in order."""
    rows = spark.range(300_000).selectExpr("if(id % 1000 = 0, 'cold', 'hot') as k", "cast(hash(id) as double) as v").repartition(8)
    found = quantiles.percentiles(rows, ["k"], "v", [0.5, 0.95], most=1000)
    got = {r["k"]: r["percentiles"] for r in found.collect()}
    table = rows.toPandas()
    for k, own in table.groupby("k"):
        assert np.allclose(got[k], np.percentile(own["v"], [50, 95]), rtol=1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_sketches(spark):
    events = spark.range(2000).selectExpr("cast(id % 50 as string) as case_id", "concat('a', id % 3) as activity", "timestamp_seconds(id * id) as ts", "id as event_id")
    for exact, rough in ((log.transition_metrics(events), log.transition_metrics(events, 10_000)), (log.bottlenecks(events), log.bottlenecks(events, accuracy=10_000)), (log.case_duration_summary(events), log.case_duration_summary(events, 10_000))):
        a, b = exact.toPandas(), rough.toPandas()
        assert list(a.columns) == list(b.columns) and len(a) == len(b)
        for c in a.columns:
            if c.endswith("_hours"):
                assert np.allclose(sorted(a[c]), sorted(b[c]), rtol=0.1)
