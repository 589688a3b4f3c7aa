"""Alerts with rest and cap, over thresholds that change in time, and their acknowledgement.

What happens to a case is a fold over its rows in the order of time. The same fold runs here, over a table that is
dealt by case and sorted, one row in memory at a time, and in the stream over rows that the watermark has passed; so
both give the same alerts.

Controls are rows (ts, action, ...): `add` brings a threshold, `remove` takes all of an alert and a prediction type,
`acknowledge` confirms the open alerts of a case, an alert type and a severity. At one time they go in this order and
before predictions: remove, add, prediction, acknowledge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALERTS = "case_id string, alert_type string, severity string, probability double, ts timestamp"
EVENTS = f"event string, {ALERTS}, by string, at timestamp"
#: Columns of controls beside ts and action.
CONTROL = "alert_type string, prediction_type string, comparison string, threshold double, severity string, cooldown_minutes int, case_id string, user string"
#: What equals means for numbers.
CLOSE = 1e-6


def passed(p: Column, comparison: Column, threshold: Column) -> Column:
    how = comparison
    return F.when(how == "gt", p > threshold).when(how == "gte", p >= threshold).when(how == "lt", p < threshold).when(how == "lte", p <= threshold).when(how == "eq", F.abs(p - threshold) < CLOSE).otherwise(False)


def passes(p: float, comparison: str, threshold: float) -> bool:
    return {"gt": p > threshold, "lt": p < threshold, "gte": p >= threshold, "lte": p <= threshold, "eq": abs(p - threshold) < CLOSE}.get(comparison, False)


class Case:
    """The alerts of a case so far. All times are in microseconds."""

    def __init__(self, most: int, expiry: int | None):
        self.most, self.expiry = most, expiry
        self.count, self.seen, self.rests, self.open = 0, 0, {}, {}

    def over(self, t: int) -> bool:
        """Whether the case is closed by then: nothing came for as long as the expiry."""
        return self.expiry is not None and bool(self.seen) and t - self.seen >= self.expiry

    def hit(self, t: int, kind: str, rest: int, probability: float) -> bool:
        if self.over(t):
            self.count, self.rests, self.open = 0, {}, {}
        self.seen = t
        if self.count >= self.most or (kind in self.rests and t - self.rests[kind] < rest):
            return False
        self.count, self.rests[kind] = self.count + 1, t
        self.open.setdefault(kind, []).append((t, probability))
        return True

    def acknowledge(self, t: int, kind: str) -> list[tuple[int, float]]:
        return [] if self.over(t) else self.open.pop(kind, [])

    def state(self) -> list:
        return [self.count, self.seen, self.rests, self.open]

    def load(self, state: list) -> Case:
        self.count, self.seen, self.rests, self.open = state
        return self


def kind_of(alert_type: str, severity: str) -> str:
    return f"{alert_type}\0{severity}"


def threshold_periods(controls: DataFrame | None, thresholds: DataFrame) -> DataFrame:
    """thresholds with from_ts and to_ts (null: without end); the given ones hold from the start."""
    names = ["alert_type", "prediction_type", "comparison", "threshold", "severity", "cooldown_minutes"]
    first = thresholds.select(*names, F.lit(None).cast("timestamp").alias("from_ts"))
    if controls is None:
        return first.withColumn("to_ts", F.lit(None).cast("timestamp"))
    adds = first.union(controls.where("action = 'add'").select(*names, F.col("ts").alias("from_ts")))
    removes = controls.where("action = 'remove'").select(F.col("alert_type").alias("_a"), F.col("prediction_type").alias("_p"), F.col("ts").alias("_t"))
    gone = (F.col("alert_type") == F.col("_a")) & (F.col("prediction_type") == F.col("_p")) & (F.col("from_ts").isNull() | (F.col("_t") > F.col("from_ts")))
    return adds.join(removes, gone, "left").groupBy(*names, "from_ts").agg(F.min("_t").alias("to_ts"))


def hits_in_time(predictions: DataFrame, periods: DataFrame) -> DataFrame:
    """Predictions (case_id, prediction_type, probability, ts) with each threshold that they pass while it holds."""
    holds = (F.col("from_ts").isNull() | (F.col("ts") >= F.col("from_ts"))) & (F.col("to_ts").isNull() | (F.col("ts") < F.col("to_ts")))
    return predictions.join(periods, "prediction_type").where(holds & passed(F.col("probability"), F.col("comparison"), F.col("threshold")))


def _rows(hits: DataFrame, controls: DataFrame | None, ts: str) -> DataFrame:
    micros = F.unix_micros(F.col(ts).cast("timestamp")).alias("t")
    rows = hits.select("case_id", micros, F.lit(0).alias("order"), "alert_type", "severity", F.col("probability").cast("double").alias("probability"), (F.col("cooldown_minutes").cast("long") * 60_000_000).alias("rest"), F.lit(None).cast("string").alias("by"))
    if controls is not None:
        asked = controls.where("action = 'acknowledge'")
        rows = rows.union(asked.select("case_id", F.unix_micros("ts"), F.lit(1), "alert_type", "severity", F.lit(0.0), F.lit(0).cast("long"), "user"))
    order = ["t", "order", "alert_type", "severity", "probability", "rest"]
    return rows.repartition("case_id").sortWithinPartitions("case_id", *order)


def _stamp(t: int) -> pd.Timestamp:
    return pd.Timestamp(t, unit="us")


def alert_events(hits: DataFrame, controls: DataFrame | None = None, most: int = 10, ts: str = "ts", expiry_minutes: int | None = None) -> DataFrame:
    """Rows of EVENTS: each alert (event `alert`) and each acknowledged one (`acknowledged`, with who and when).

    Of a case, an alert type and a severity, a hit within the rest of the last alert is dropped and doesn't start a new
    rest; a case has `most` alerts at most; after `expiry_minutes` without a hit it starts anew. Null cases are one."""
    expiry = None if expiry_minutes is None else expiry_minutes * 60_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, case = None, object()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.case_id != case:
                    now, case = Case(most, expiry), row.case_id
                kind = kind_of(row.alert_type, row.severity)
                if row.order:
                    out += [("acknowledged", case, row.alert_type, row.severity, p, _stamp(t), row.by, _stamp(row.t)) for t, p in now.acknowledge(row.t, kind)]
                elif now.hit(row.t, kind, row.rest, row.probability):
                    out.append(("alert", case, row.alert_type, row.severity, row.probability, _stamp(row.t), None, None))
            yield pd.DataFrame(out, columns=["event", "case_id", "alert_type", "severity", "probability", "ts", "by", "at"])

    return _rows(hits, controls, ts).mapInPandas(run, EVENTS)


def alert_states(events: DataFrame) -> DataFrame:
    """One row an alert: whether it is acknowledged, by whom and when."""
    own = events.groupBy("case_id", "alert_type", "severity", "ts").agg(F.max("probability").alias("probability"), F.max(F.struct("at", "by")).alias("_a"))
    return own.select("case_id", "alert_type", "severity", "probability", "ts", F.col("_a.at").isNotNull().alias("acknowledged"), F.col("_a.by").alias("acknowledged_by"), F.col("_a.at").alias("acknowledged_at"))
