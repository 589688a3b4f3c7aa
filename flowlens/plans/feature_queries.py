"""Queries on case features, scores, risk and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerting
from ..operators import features as R
from ..sources.fixtures import AS_OF

_M = "CASE activity WHEN 'OrderCreated' THEN 0 WHEN 'OrderReleased' THEN 1 WHEN 'DeliveryCreated' THEN 2 WHEN 'GoodsIssued' THEN 3 WHEN 'InvoiceCreated' THEN 4 WHEN 'PaymentReceived' THEN 5 END"
_W = "(PARTITION BY case_id ORDER BY ts, event_id, activity)"
_NOW = f"epoch_us(TIMESTAMP '{AS_OF}')"
_H = "/ 3.6e9"


def _level(p: str) -> str:
    return f"CASE WHEN {p} >= 0.8 THEN 'critical' WHEN {p} >= 0.6 THEN 'high' WHEN {p} >= 0.4 THEN 'medium' WHEN {p} >= 0.2 THEN 'low' ELSE 'minimal' END"


def _score(parts: list[tuple[str, str, str]]) -> tuple[str, str]:
    total = " + ".join(f"CASE WHEN {test} THEN {add} ELSE 0.0 END" for _, test, add in parts)
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test, _ in parts) + ")"
    return f"round(greatest(0.0, least(1.0, {total})), 4)", names


_LATE = _score([
    ("case_age", "case_age > 72", "least(case_age / 336, 1.0) * 0.25"), ("low_progress", "progress < 0.5 AND case_age > 48", "(1 - progress) * 0.2"), ("stalled", "idle_hours > 24", "least(idle_hours / 168, 1.0) * 0.2"),
    ("credit_hold", "has_credit_hold", "0.3"), ("rework", "has_rework", "0.1"), ("backtracks", "backtrack_count > 0", "least(backtrack_count * 0.1, 0.2)"), ("weekend_start", "is_weekend_start", "0.05"),
    ("goods_issued", "has_goods_issued", "-0.3"), ("delivery_created", "has_delivery AND NOT has_goods_issued", "-0.15"),
])
_CREDIT = _score([
    ("no_credit_check", "NOT has_credit_check AND event_count > 2", "0.3"), ("high_complexity", "complexity > 0.5", "complexity * 0.2"), ("rejection_history", "rejection_detected", "0.25"), ("block_history", "block_detected", "0.2"),
    ("credit_check_passed", "has_credit_check", "-0.4"), ("late_stage", "has_goods_issued OR has_invoice", "-0.3"),
])
_HOURS = """greatest(0.0, CASE WHEN progress >= 0.95 THEN least(x, 24.0) ELSE x END) FROM (SELECT *, (CASE WHEN event_count > 1 AND avg_gap_hours > 0 THEN (120 * (1 - progress) + ceil(round((1 - progress) * 7, 6)) * 3 * avg_gap_hours) / 2 ELSE 120 * (1 - progress) END
    + CASE WHEN has_credit_hold THEN 48 ELSE 0 END) * CASE WHEN has_rework THEN 1.2 ELSE 1.0 END + backtrack_count * 12 AS x FROM ft_ext)"""
VIEWS = {
    "ft_gaps": f"SELECT *, {_M} AS m, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) {_H} AS gap, lag({_M}) OVER w AS mb FROM fx_o2c_log WINDOW w AS {_W}",
    "ft_case": f"""SELECT g.case_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) {_H}, 4) AS total_duration, round(({_NOW} - epoch_us(min(ts))) {_H}, 4) AS time_since_start, round(coalesce(avg(gap), 0), 4) AS avg_activity_duration,
        round(coalesce(max(gap), 0), 4) AS max_activity_duration, round(coalesce(min(gap), 0), 4) AS min_activity_duration, round(coalesce(stddev_pop(gap), 0), 4) AS std_activity_duration,
        round(coalesce((epoch_us(max(ts) FILTER (m IS NOT NULL)) - epoch_us(min(ts))) {_H}, 0), 4) AS time_to_last_milestone, count(*) AS event_count, count(DISTINCT activity) AS unique_activity_count,
        count(*) FILTER (activity = 'OrderChanged') AS order_change_count, count(*) FILTER (activity = 'CreditBlock') AS credit_block_count, {", ".join(f"count(*) FILTER (activity = '{a}') AS count_{a}" for a in R.COUNTED)},
        max(CAST(activity = 'CreditBlock' AS INT)) AS has_credit_block, max(CAST(activity = 'OrderChanged' AS INT)) AS has_order_changes, count(*) FILTER (m < mb) AS backward_flow_count, coalesce(max(m), 0) AS current_stage,
        greatest(max(CAST(activity = 'CreditBlock' AS INT)) - max(CAST(activity = 'CreditRelease' AS INT)), 0) AS is_blocked, round(coalesce(({_NOW} - epoch_us(max(ts) FILTER (m IS NOT NULL))) {_H} / 24, 0), 4) AS days_in_current_stage,
        max(rework_count) AS rework_count, round(coalesce(max(m), 0) / 5.0 * 100, 4) AS completion_percentage FROM ft_gaps g
        JOIN (SELECT case_id, count(*) FILTER (n > 1) AS rework_count FROM (SELECT case_id, activity, count(*) AS n FROM fx_o2c_log GROUP BY ALL) GROUP BY 1) r ON g.case_id = r.case_id GROUP BY g.case_id""",
    "ft_high": "SELECT *, max(m) OVER (PARTITION BY case_id ORDER BY ts, event_id, activity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ft_gaps",
    "ft_agg": f"""SELECT case_id, round(({_NOW} - epoch_us(min(ts))) {_H}, 4) AS case_age, round(({_NOW} - epoch_us(max(ts))) {_H}, 4) AS idle_hours, count(*) AS event_count, round((epoch_us(max(ts)) - epoch_us(min(ts))) {_H} / greatest(count(*) - 1, 1), 4) AS avg_gap_hours,
        bool_or(activity = 'CreditBlock') AND NOT bool_or(activity = 'CreditRelease') AS has_credit_hold, bool_or(activity LIKE 'Credit%') AS has_credit_check, bool_or(activity = 'GoodsIssued') AS has_goods_issued, bool_or(activity = 'DeliveryCreated') AS has_delivery,
        bool_or(activity = 'InvoiceCreated') AS has_invoice, FALSE AS rejection_detected, bool_or(activity = 'CreditBlock') AS block_detected, count(*) - count(DISTINCT activity) AS loop_count, count(*) FILTER (m < high) AS backtrack_count,
        dayofweek(min(ts)) IN (0, 6) AS is_weekend_start, round(count(DISTINCT m) / 6.0, 4) AS progress, round(least(1.0, count(DISTINCT activity) / 20.0 + (count(*) - count(DISTINCT activity)) / 20.0), 4) AS complexity FROM ft_high GROUP BY 1""",
    "ft_ext": """SELECT *, loop_count > 0 AS has_rework, concat_ws(',', CASE WHEN block_detected THEN 'block_detected' END, CASE WHEN loop_count > 0 THEN 'rework_detected' END, CASE WHEN idle_hours > 168 THEN 'long_idle' END) AS risk_indicators FROM ft_agg""",
    "ft_late": f"SELECT case_id, {_LATE[0]} AS probability, {_LATE[1]} AS factors FROM ft_ext",
    "ft_credit": f"SELECT case_id, CASE WHEN has_credit_hold THEN 1.0 ELSE {_CREDIT[0]} END AS probability, CASE WHEN has_credit_hold THEN 'credit_hold_active' ELSE {_CREDIT[1]} END AS factors FROM ft_ext",
    "ft_hours": f"SELECT case_id, round(r, 2) AS remaining_hours, round(least(1.0, r / 336), 4) AS probability FROM (SELECT case_id, {_HOURS.replace(' FROM (SELECT *', ' AS r FROM (SELECT *', 1)})",
    "ft_pred": "SELECT case_id, 'late_delivery' AS prediction_type, probability, factors FROM ft_late UNION ALL SELECT case_id, 'credit_hold', probability, factors FROM ft_credit UNION ALL SELECT case_id, 'completion_time', probability, '' FROM ft_hours",
    "ft_risk": f"SELECT *, {_level('highest')} AS risk_level FROM (SELECT case_id, round(sum(probability * w) / sum(w) * 100, 2) AS risk_score, max(probability) AS highest FROM (SELECT *, CASE prediction_type WHEN 'late_delivery' THEN 0.4 WHEN 'credit_hold' THEN 0.35 ELSE 0.25 END AS w FROM ft_pred) GROUP BY 1)",
    "ft_hits": "SELECT p.*, alert_type, severity FROM ft_pred p JOIN (VALUES ('late_delivery', 'late_delivery_risk', 0.7, 'high'), ('late_delivery', 'late_delivery_risk', 0.9, 'critical'), ('credit_hold', 'credit_hold_risk', 0.6, 'medium'), ('credit_hold', 'credit_hold_risk', 0.85, 'high')) t(prediction_type, alert_type, threshold, severity) ON p.prediction_type = t.prediction_type AND probability >= threshold",
}


def _ext(t):
    return R.case_features_ext(t.o2c_log(), AS_OF)


def _typed(t):
    kinds = F.when(F.col("prediction_type") == "completion_time", "raw").when(F.col("prediction_type") == "credit_hold", "heuristic").otherwise("probability")
    return R.predictions(_ext(t)).select("case_id", "prediction_type", F.when(kinds == "raw", F.col("probability") * 336).otherwise(F.col("probability")).alias("value"), kinds.alias("value_type"))


def _timed(t):
    """Every event as a prediction, so that rest and cap take effect."""
    return t.event_log().select("case_id", "ts", (F.col("value") / 50).alias("probability"), F.lit("late_delivery").alias("prediction_type"))


def _alerts(t):
    return R.threshold_alerts(R.threshold_hits(_timed(t)))


def _asked(t):
    """Controls: errors acknowledge the high alerts of their case, and thresholds change twice."""
    own = t.event_log().where("activity = 'error'").select("ts", F.lit("acknowledge").alias("action"), F.lit("late_delivery_risk").alias("alert_type"), F.lit("high").alias("severity"), "case_id", F.col("resource").alias("user"))
    made = t.spark.createDataFrame([("2024-01-10 00:00:00", "remove", None, None, None), ("2024-01-20 00:00:00", "add", "gt", 0.5, "medium")], "ts string, action string, comparison string, threshold double, severity string")
    made = made.select(F.col("ts").cast("timestamp").alias("ts"), "action", F.lit("late_delivery_risk").alias("alert_type"), F.lit("late_delivery").alias("prediction_type"), "comparison", "threshold", "severity", F.lit(60).alias("cooldown_minutes"))
    return own.unionByName(made, allowMissingColumns=True)


def _hits_in_time(t):
    return alerting.hits_in_time(_timed(t), alerting.threshold_periods(_asked(t), R.threshold_table(t.spark)))


def _states(t):
    asked = _asked(t).where("action = 'acknowledge'")
    return alerting.alert_states(alerting.alert_events(R.threshold_hits(_timed(t)), asked))


#: Alerts one hit after the other: n so far and the last time of each severity.
_FOLD = """WITH RECURSIVE f AS (SELECT *, TRUE AS kept, 1 AS n, CASE WHEN severity = 'high' THEN t END AS high, CASE WHEN severity = 'critical' THEN t END AS critical FROM al_hits WHERE rn = 1
    UNION ALL SELECT h.*, k.kept, f.n + CAST(k.kept AS INT), CASE WHEN k.kept AND h.severity = 'high' THEN h.t ELSE f.high END, CASE WHEN k.kept AND h.severity = 'critical' THEN h.t ELSE f.critical END FROM f JOIN al_hits h ON h.case_id = f.case_id AND h.rn = f.rn + 1,
    LATERAL (SELECT f.n < 10 AND coalesce(h.t - CASE h.severity WHEN 'high' THEN f.high ELSE f.critical END >= h.rest, TRUE) AS kept) k) SELECT case_id, alert_type, severity, probability, ts FROM f WHERE kept"""
VIEWS |= {
    "al_hits": """SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY t, alert_type, severity, probability) AS rn FROM (SELECT case_id, 'late_delivery_risk' AS alert_type, severity, value / 50 AS probability, ts, epoch_us(ts) AS t, rest * CAST(60000000 AS BIGINT) AS rest
        FROM fx_event_log JOIN (VALUES (0.7, 'high', 60), (0.9, 'critical', 30)) x(limit_, severity, rest) ON value / 50 >= limit_)""",
    "al_alerts": f"SELECT * FROM ({_FOLD})",
}


QUERIES = {
    "case_features": (lambda t: R.case_features(t.o2c_log(), AS_OF), "SELECT * FROM ft_case"),
    "case_features_ext": (_ext, "SELECT * FROM ft_ext"),
    "score_late_delivery": (lambda t: R.score_late_delivery(_ext(t)), "SELECT * FROM ft_late"),
    "score_credit_hold": (lambda t: R.score_credit_hold(_ext(t)), "SELECT * FROM ft_credit"),
    "score_completion_time": (lambda t: R.score_completion_time(_ext(t)), "SELECT * FROM ft_hours"),
    "composite_risk": (lambda t: R.composite_risk(R.predictions(_ext(t))), "SELECT * FROM ft_risk"),
    "rank_by_risk": (lambda t: R.rank_by_risk(R.predictions(_ext(t))), "SELECT * FROM ft_risk ORDER BY risk_score DESC, case_id LIMIT 50"),
    "risk_distribution": (lambda t: R.risk_distribution(R.predictions(_ext(t))), f"SELECT prediction_type, {_level('probability')} AS risk_level, count(*) AS n, round(avg(probability), 4) AS avg_probability FROM ft_pred GROUP BY 1, 2"),
    "top_risk_factors": (lambda t: R.top_risk_factors(R.predictions(_ext(t))), "SELECT factor, count(*) AS n FROM (SELECT unnest(string_split(factors, ',')) AS factor FROM ft_pred WHERE factors <> '') GROUP BY 1 ORDER BY n DESC, factor LIMIT 10"),
    "threshold_hits": (lambda t: R.threshold_hits(R.predictions(_ext(t))).select("case_id", "prediction_type", "probability", "factors", "alert_type", "severity"), "SELECT * FROM ft_hits"),
    "alert_summary": (lambda t: R.alert_summary(R.threshold_hits(R.predictions(_ext(t)))), "SELECT 'severity' AS dimension, severity AS value, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM ft_hits GROUP BY 2 UNION ALL SELECT 'type', alert_type, count(*), count(DISTINCT case_id) FROM ft_hits GROUP BY 2"),
    "threshold_alerts": (_alerts, "SELECT * FROM al_alerts"),
    "alert_states": (_states, """SELECT a.*, c.at IS NOT NULL AS acknowledged, c.by AS acknowledged_by, c.at AS acknowledged_at FROM al_alerts a LEFT JOIN LATERAL
        (SELECT e.ts AS at, e.resource AS by FROM fx_event_log e WHERE e.activity = 'error' AND e.case_id = a.case_id AND a.severity = 'high' AND e.ts >= a.ts ORDER BY e.ts LIMIT 1) c ON TRUE"""),
    "hits_in_time": (lambda t: _hits_in_time(t).select("case_id", "ts", "probability", "severity", "cooldown_minutes"), """SELECT case_id, ts, value / 50 AS probability, severity, rest AS cooldown_minutes FROM fx_event_log JOIN (VALUES ('gte', 0.7, 'high', 60, '2000-01-01', '2024-01-10'), ('gte', 0.9, 'critical', 30, '2000-01-01', '2024-01-10'),
        ('gt', 0.5, 'medium', 60, '2024-01-20', '2100-01-01')) x(how, limit_, severity, rest, a, b) ON ts >= CAST(a AS TIMESTAMP) AND ts < CAST(b AS TIMESTAMP) AND CASE how WHEN 'gt' THEN value / 50 > limit_ ELSE value / 50 >= limit_ END"""),
    "weighted_risk": (lambda t: R.weighted_risk(_typed(t), 336.0), f"""SELECT *, {_level('risk_score')} AS risk_level FROM (SELECT case_id, round(greatest(0.0, least(1.0, coalesce(sum(risk * w) / sum(w) FILTER (risk IS NOT NULL), 0.0))), 4) AS risk_score, count(risk) AS n_used, count(*) - count(risk) AS n_excluded
        FROM (SELECT case_id, CASE prediction_type WHEN 'credit_hold' THEN NULL WHEN 'completion_time' THEN least(1.0, probability * 336 / 336.0) ELSE probability END AS risk, CASE prediction_type WHEN 'late_delivery' THEN 0.4 WHEN 'credit_hold' THEN 0.35 ELSE 0.25 END AS w FROM ft_pred) GROUP BY 1)"""),
    "recommendations": (lambda t: R.recommendations(R.predictions(_ext(t))), "SELECT case_id, prediction_type, array_to_string(([x for x in [CASE y " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ADVICE.items()) + " END for y in string_split(factors, ',')] if x IS NOT NULL])[1:3], '; ') AS recommendations FROM ft_pred"),
    "case_summary": (lambda t: R.case_summary(R.predictions(_ext(t))), "SELECT case_id, max(probability) AS highest, count(*) FILTER (probability >= 0.6) AS n_high, array_to_string(list_sort(list_distinct(flatten(list([CASE y " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in R.ADVICE.items()) + " END for y in string_split(factors, ',')]))))[1:5], '; ') AS recommendations FROM ft_pred GROUP BY 1"),
}
