"""Structured Streaming forms: activity counts per window, and threshold alerts with rest, cap and controls per case."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerting import CONTROL, EVENTS, Case, kind_of, passes
from ..operators.features import threshold_table

#: Where the state of a stream with timers and maps has to live.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_activity_counts(log: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """n per window and activity of a stream with ts and activity; late rows are dropped after `delay`."""
    spans = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = log.withWatermark("ts", delay).groupBy(spans.alias("w"), "activity").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "activity", "n")


#: At one time: what goes before what.
ORDER = {"remove": 0, "add": 1, "predict": 2, "acknowledge": 3}
FIELDS = ["case_id", "alert_type", "prediction_type", "comparison", "threshold", "severity", "cooldown_minutes", "probability", "user"]


class Alerter(StatefulProcessor):
    """The cases of one share and the thresholds that hold there.

    Rows wait until the watermark has passed them and are then worked on in the order of their time, so that a late row
    (within the delay) counts where it belongs. One timer is set, to the first row that waits or case that is to close."""

    def __init__(self, most: int, expiry_minutes: int | None):
        self.most, self.expiry = most, None if expiry_minutes is None else expiry_minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thresholds = handle.getMapState("thresholds", "name string", "rest long")
        self.waiting = handle.getMapState("waiting", "t long, n long", "row string")
        self.cases = handle.getMapState("cases", "case_id string", "state string")
        self.counter = handle.getValueState("counter", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            self._add(row)

    def _add(self, row) -> None:
        name = json.dumps([row.alert_type, row.prediction_type, row.comparison, float(row.threshold), row.severity])
        self.thresholds.updateValue((name,), (int(row.cooldown_minutes) * 60_000_000,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.counter.get()[0] if self.counter.exists() else 0
        for batch in rows:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                t = pd.Timestamp(row["ts"]).value // 1000
                self.waiting.updateValue((t, n), (json.dumps([row["action"], *(row[f] for f in FIELDS)]),))
                n += 1
        self.counter.update((n,))
        self._wake(timerValues)
        yield pd.DataFrame(columns=_columns())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        due = []
        for (t, n), (row,) in list(self.waiting.iterator()):
            if t <= upto:
                self.waiting.removeKey((t, n))
                due.append((t, *json.loads(row)))
        due.sort(key=lambda r: (r[0], ORDER[r[1]], r[2] or "", r[3] or "", r[6] or ""))
        known = {tuple(json.loads(name)): rest for (name,), (rest,) in self.thresholds.iterator()} if due else {}
        held: dict[str, Case] = {}
        out = []

        def case_of(name: str) -> Case:
            if name not in held:
                held[name] = self._case(name)
            return held[name]

        for (t, _), group in groupby(due, key=lambda r: (r[0], ORDER[r[1]])):
            hits = []
            for _, action, *fields in group:
                row = dict(zip(FIELDS, fields, strict=True))
                if action in ("add", "remove"):
                    self._change(known, action, row)
                elif action == "acknowledge":
                    found = case_of(row["case_id"]).acknowledge(t, kind_of(row["alert_type"], row["severity"]))
                    out += [("acknowledged", row["case_id"], row["alert_type"], row["severity"], p, _stamp(a), row["user"], _stamp(t)) for a, p in found]
                else:
                    p = row["probability"]
                    hits += [(alert, severity, p, rest, row["case_id"]) for (alert, kind, how, limit, severity), rest in known.items() if kind == row["prediction_type"] and p is not None and passes(p, how, limit)]
            for alert, severity, p, rest, name in sorted(hits, key=lambda h: h[:4]):
                if case_of(name).hit(t, kind_of(alert, severity), rest, p):
                    out.append(("alert", name, alert, severity, p, _stamp(t), None, None))
        for name, case in held.items():
            if case.seen:
                self.cases.updateValue((name,), (json.dumps(case.state()),))
        if self.expiry is not None:
            for (name,), (state,) in list(self.cases.iterator()):
                if json.loads(state)[1] + self.expiry <= upto:
                    self.cases.removeKey((name,))
        self._wake(timerValues)
        yield pd.DataFrame(out, columns=_columns())

    def _case(self, name: str) -> Case:
        case = Case(self.most, self.expiry)
        return case.load(json.loads(self.cases.getValue((name,))[0])) if self.cases.containsKey((name,)) else case

    def _change(self, known: dict, action: str, row: dict) -> None:
        if action == "add":
            name = (row["alert_type"], row["prediction_type"], row["comparison"], float(row["threshold"]), row["severity"])
            known[name] = int(row["cooldown_minutes"]) * 60_000_000
            self.thresholds.updateValue((json.dumps(list(name)),), (known[name],))
            return
        for name in [n for n in known if n[:2] == (row["alert_type"], row["prediction_type"])]:
            del known[name]
            self.thresholds.removeKey((json.dumps(list(name)),))

    def _wake(self, timerValues) -> None:
        """One timer: at the first row that waits, or at the first end of a case."""
        times = [t for (t, _), _ in self.waiting.iterator()]
        if self.expiry is not None:
            times += [json.loads(state)[1] + self.expiry for _, (state,) in self.cases.iterator()]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(max(-(-min(times) // 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def _columns() -> list[str]:
    return [c.split(" ")[0] for c in EVENTS.split(", ")]


def _stamp(t: int) -> pd.Timestamp:
    return pd.Timestamp(t, unit="us")


def stream_alerts(predictions: DataFrame, controls: DataFrame | None = None, thresholds: DataFrame | None = None, most: int = 10, delay: str = "2 hours", expiry_minutes: int | None = None, shares: int = 64) -> DataFrame:
    """Alerts and acknowledgements (rows of EVENTS) of a stream of predictions (case_id, prediction_type, probability, ts).

    controls: a second stream (ts, action and the columns of CONTROL); both go through one operator, dealt to `shares` by
    case. Changes of thresholds go to all shares, so `shares` should be a few times the tasks at most. thresholds: a table
    of those that hold at the start, by default the common ones; they are the operator's initial state."""
    spark = predictions.sparkSession
    spark.conf.set(*STATE_STORE)
    start = thresholds if thresholds is not None else threshold_table(spark)
    share = F.pmod(F.xxhash64("case_id"), F.lit(shares)).cast("int").alias("share")
    none = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]) for c in f"{CONTROL}, probability double".split(", ")}

    def row(df: DataFrame, share_of, action, **own) -> DataFrame:
        return df.select(share_of, "ts", action, *(own.get(f, none[f]).alias(f) for f in FIELDS))

    rows = row(predictions, share, F.lit("predict").alias("action"), **{c: F.col(c) for c in ("case_id", "prediction_type")}, probability=F.col("probability").cast("double"))
    if controls is not None:
        own = {c.split(" ")[0]: F.col(c.split(" ")[0]).cast(c.split(" ")[1]) for c in CONTROL.split(", ")}
        every = F.when(F.col("action") == "acknowledge", F.array(share)).otherwise(F.sequence(F.lit(0), F.lit(shares - 1)))
        rows = rows.unionByName(row(controls.withColumn("_share", F.explode(every)), F.col("_share").alias("share"), F.col("action"), **own))
    first = start.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).groupBy("share")
    return rows.withWatermark("ts", delay).groupBy("share").transformWithStateInPandas(Alerter(most, expiry_minutes), EVENTS, "Append", "EventTime", initialState=first)


def send_alerts(alerts: DataFrame, handle, checkpoint: str):
    """Start a query that hands each batch of alerts to handle(DataFrame, batch id)."""
    return alerts.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
