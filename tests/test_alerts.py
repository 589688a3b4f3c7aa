"""Alerts: thresholds that change, rest, cap, expiry and acknowledgement; the stream against the table."""

import datetime
import random
import shutil

import pytest

from flowlens.operators import alerting, features
from flowlens.streaming import alerts

START = datetime.datetime(2024, 1, 1)
PREDICTIONS = "case_id string, prediction_type string, probability double, ts timestamp"
CONTROLS = f"ts timestamp, action string, {alerting.CONTROL}"


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def made():
    draw = random.Random(9)
    rows = [(f"c{draw.randrange(6)}", draw.choice(["late_delivery", "credit_hold", "rework"]), round(draw.random(), 3), at(draw.randrange(2000))) for _ in range(700)]
    rows += [("c0", "late_delivery", 0.95, at(m)) for m in range(100, 1500, 20)]
    new = ("rework_risk", "rework", "gt", 0.5, "medium", 45, None, None)
    controls = [
        (at(300), "add", *new), (at(900), "remove", "rework_risk", "rework", *[None] * 6), (at(1200), "add", "rework_risk", "rework", "lt", 0.3, "low", 10, None, None),
        (at(1000), "remove", "credit_hold_risk", "credit_hold", *[None] * 6), (at(1000), "add", "credit_hold_risk", "credit_hold", "eq", 0.5, "high", 5, None, None),
        *[(at(m), "acknowledge", "late_delivery_risk", None, None, None, "critical", None, f"c{c}", "ann") for m, c in ((150, 0), (151, 0), (700, 1), (1400, 2))],
        (at(800), "acknowledge", "rework_risk", None, None, None, "medium", None, "c3", "bob"),
    ]
    return rows, controls


def slow(rows, controls, most, expiry):
    """One row after the other, in the order of time."""
    names = {"late_delivery": "late_delivery_risk"}
    known = [(kind, alert, how, limit, severity, rest) for kind, alert, how, limit, severity, rest in features.THRESHOLDS]
    order = {"remove": 0, "add": 1, "predict": 2, "acknowledge": 3}
    everything = [(r[3], "predict", r) for r in rows] + [(c[0], c[1], c) for c in controls]
    times = sorted({(t, order[a]) for t, a, _ in everything})
    state, out = {}, []
    by_time = {}
    for t, a, r in everything:
        by_time.setdefault((t, order[a]), []).append((a, r))
    for t, _ in times:
        hits = []
        for a, r in by_time[t, _]:
            if a == "remove":
                known = [k for k in known if (k[1], k[0]) != (r[2], r[3])]
            elif a == "add":
                known.append((r[3], r[2], r[4], r[5], r[6], r[7]))
            elif a == "acknowledge":
                case = state.get(r[8])
                if case and (expiry is None or (t - case["seen"]).total_seconds() < expiry * 60):
                    for alert in [x for x in case["open"] if x[1:3] == (r[2], r[6])]:
                        case["open"].remove(alert)
                        out.append(("acknowledged", r[8], r[2], r[6], alert[3], alert[0], r[9], t))
            else:
                for kind, alert, how, limit, severity, rest in known:
                    if kind == r[1] and alerting.passes(r[2], how, limit):
                        hits.append((alert, severity, r[2], rest, r[0]))
        for alert, severity, p, rest, name in sorted(hits):
            case = state.setdefault(name, {"n": 0, "last": {}, "open": [], "seen": t})
            if expiry is not None and (t - case["seen"]).total_seconds() >= expiry * 60:
                case.update(n=0, last={}, open=[])
            case["seen"] = t
            last = case["last"].get((alert, severity))
            if case["n"] < most and (last is None or (t - last).total_seconds() >= rest * 60):
                case["n"] += 1
                case["last"][alert, severity] = t
                case["open"].append((t, alert, severity, p))
                out.append(("alert", name, alert, severity, p, t, None, None))
    assert names
    return sorted(out, key=repr)


@pytest.mark.parametrize("most, expiry", [(10, None), (4, 60), (1000, 200)])
def test_table(spark, most, expiry):
    rows, controls = made()
    asked = spark.createDataFrame(controls, CONTROLS)
    periods = alerting.threshold_periods(asked, features.threshold_table(spark))
    hits = alerting.hits_in_time(spark.createDataFrame(rows, PREDICTIONS), periods)
    events = alerting.alert_events(hits, asked, most, expiry_minutes=expiry)
    want = slow(rows, controls, most, expiry)
    assert sorted(map(tuple, events.collect()), key=repr) == want
    states = alerting.alert_states(events).collect()
    assert len(states) == sum(w[0] == "alert" for w in want) and sum(s["acknowledged"] for s in states) == sum(w[0] == "acknowledged" for w in want) > 0


@pytest.mark.parametrize("most, expiry", [(4, 60), (10, None)])
def test_stream_gives_what_the_table_gives(spark, tmp_path, most, expiry):
    """Shuffled within the delay, over several batches and shares, with controls that come between."""
    rows, controls = made()
    want = slow(rows, controls, most, expiry)
    draw = random.Random(2)
    late = sorted([("p", r[3], r) for r in rows] + [("c", c[0], c) for c in controls], key=lambda x: x[1] + datetime.timedelta(minutes=draw.randrange(100)))
    size = -(-len(late) // 5)
    for folder in ("p", "c", "p_all", "c_all"):
        (tmp_path / folder).mkdir()
    spark.conf.set(*alerts.STATE_STORE)
    predictions = spark.readStream.schema(PREDICTIONS).parquet(str(tmp_path / "p"))
    control = spark.readStream.schema(CONTROLS).parquet(str(tmp_path / "c"))
    events = alerts.stream_alerts(predictions, control, most=most, delay="2 hours", expiry_minutes=expiry, shares=3)
    got = []
    query = alerts.send_alerts(events, lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "cp"))
    try:
        for i in range(6):
            part = late[i * size : (i + 1) * size]
            own = {"p": [r for k, _, r in part if k == "p"], "c": [r for k, _, r in part if k == "c"]}
            if i == 5:  # far ahead, so that the watermark passes all; and one that comes too late
                own["p"] = [("end", "late_delivery", 0.0, at(9000))]
            for kind, schema in (("p", PREDICTIONS), ("c", CONTROLS)):
                if own[kind]:
                    spark.createDataFrame(own[kind], schema).coalesce(1).write.parquet(str(tmp_path / f"{kind}_all" / str(i)))
                    for file in (tmp_path / f"{kind}_all" / str(i)).glob("*.parquet"):
                        shutil.copy(file, tmp_path / kind / f"{i}-{file.name}")
            query.processAllAvailable()
        late_row = spark.createDataFrame([("c5", "late_delivery", 0.99, at(10))], PREDICTIONS).coalesce(1)
        late_row.write.parquet(str(tmp_path / "p_all" / "late"))
        for file in (tmp_path / "p_all" / "late").glob("*.parquet"):
            shutil.copy(file, tmp_path / "p" / f"late-{file.name}")
        query.processAllAvailable()
    finally:
        query.stop()
    assert sorted(got, key=repr) == want
