"""Conformance against a slow replay with sets, and on long cases."""

import datetime
import random
import time

import pytest

from flowlens.operators import conformance as C
from flowlens.plans import models as M
from oracle import plain

START = datetime.datetime(2024, 1, 1)
LOG = "case_id string, activity string, ts timestamp, event_id long"


def slow(rows, model):
    order = model.order()
    cases = {}
    for case, activity, ts, event in rows:
        cases.setdefault(case, []).append((ts, event, activity))
    for case, events in cases.items():
        seen, firsts = set(), {}
        named = [model.names.get(a, a) for _, _, a in sorted(events)]
        for i, a in enumerate(named):
            needs = model.mandatory_before(a)
            if a not in order:
                yield case, "unexpected_activity", a, i, ""
            else:
                if i == 0 and a not in model.starts:
                    yield case, "invalid_start", a, 0, ""
                if needs and not needs & seen and a not in model.starts:
                    yield case, "skipped_activity", a, i, ",".join(sorted(needs))
                for b in seen:
                    if order.get(b, -1) > order[a]:
                        yield case, "wrong_order", a, i, b
                if a in firsts:
                    yield case, "duplicate_activity", a, i, str(firsts[a])
                firsts.setdefault(a, i)
            seen.add(a)
        for a in model.mandatory - seen:
            yield case, "missing_activity", a, -1, ""
        if not model.mandatory - seen and named[-1] not in model.ends:
            yield case, "invalid_end", named[-1], len(named) - 1, ""


def wide():
    """A model of 70 activities, more than a word has bits."""
    model = M.Model("wide")
    names = [f"a{i:02d}" for i in range(70)]
    for i, name in enumerate(names):
        model.activity(name, "start" if i == 0 else "end" if i == 69 else "optional" if i % 3 else "step")
    return model.sequence(*names)


@pytest.mark.parametrize("make", [M.o2c_simple, M.o2c_detailed, wide])
def test_same_as_sets(spark, make):
    draw, model = random.Random(5), make()
    names = [*sorted(model.names), "elsewhere"]
    rows = [(f"c{c}", draw.choice(names), START + datetime.timedelta(minutes=draw.randrange(30)), 100 * c + e) for c in range(40) for e in range(draw.choice([1, 3, 9, 90]))]
    ordered = sorted(model.activities, key=model.order().get)
    rows += [("whole", a, START + datetime.timedelta(hours=i), i) for i, a in enumerate(ordered)]
    rows += [("unended", a, START + datetime.timedelta(hours=i), i) for i, a in enumerate([*ordered, "elsewhere"])]
    log, frames = spark.createDataFrame(rows, LOG), (model.frame(spark), model.name_frame(spark))
    got = [tuple(r)[:5] for r in C.deviations(log, *frames).collect()]
    want = list(slow(rows, model))
    assert sorted(got) == sorted(want)
    late = C.order_violations(log, *frames).collect()
    assert sorted(map(tuple, late)) == sorted((c, a, i, other) for c, kind, a, i, other in want if kind == "wrong_order")
    lacking = C.missing_activities(C.traces(log, *frames), frames[0]).collect()
    assert sorted(map(tuple, lacking)) == sorted((c, a) for c, kind, a, _, _ in want if kind == "missing_activity")
    cases = {r["case_id"]: r for r in C.check_conformance(log, *frames).collect()}
    assert len(cases) == 42 and all(r["n_deviations"] == sum(w[0] == c for w in want) for c, r in cases.items())
    assert cases["whole"]["is_conformant"] == (make is not M.o2c_detailed or not [w for w in want if w[0] == "whole"])


def test_long_case(spark):
    """A case of 100,000 events: nothing that a row carries grows with the case."""
    log = spark.range(100_000).selectExpr("'c' AS case_id", "element_at(array('OrderCreated', 'DeliveryCreated', 'GoodsIssued', 'other'), cast(1 + id % 4 AS int)) AS activity", "timestamp_seconds(id) AS ts", "id AS event_id")
    model = M.o2c_simple()
    C.check_conformance(log.limit(10), model.frame(spark), model.name_frame(spark)).collect()
    start = time.perf_counter()
    (case,) = C.check_conformance(log, model.frame(spark), model.name_frame(spark)).collect()
    assert time.perf_counter() - start < 20
    assert plain(case["n_deviations"]) == 25_000 + 3 * 24_999 + 24_999 * 2 + 24_999 + 1  # unexpected, repeats, later ones seen, missing
