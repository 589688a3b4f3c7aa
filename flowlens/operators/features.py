"""Case features, additive risk scores, risk summaries and threshold alerts.

"Now" is always a parameter. A log has case_id, activity, ts, event_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .alerting import alert_events, passed
from .log import hours, in_case

#: The order of the milestones of a sale.
MILESTONES = ["OrderCreated", "OrderReleased", "DeliveryCreated", "GoodsIssued", "InvoiceCreated", "PaymentReceived"]
COUNTED = ["OrderCreated", "OrderChanged", "OrderReleased", "CreditBlock", "CreditRelease", "DeliveryCreated", "GoodsIssued", "InvoiceCreated", "InvoicePosted", "PaymentReceived"]


def milestone(activity: Column) -> Column:
    return reduce(lambda out, pair: out.when(activity == pair[1], pair[0]), enumerate(MILESTONES[1:], 1), F.when(activity == MILESTONES[0], 0))


def case_features(log: DataFrame, as_of: str, unit_hours: float = 1.0) -> DataFrame:
    """One row a case: times in units of unit_hours, counts, patterns and the state at as_of."""
    rework = log.groupBy("case_id", "activity").agg(F.count("*").alias("_n")).groupBy("case_id").agg(F.count_if(F.col("_n") > 1).alias("rework_count"))
    percent = F.round(F.col("current_stage") / (len(MILESTONES) - 1) * 100, 4)
    return case_states(log, as_of, unit_hours).join(rework, "case_id").withColumn("completion_percentage", percent)


def case_states(log: DataFrame, as_of: str, unit_hours: float = 1.0) -> DataFrame:
    """The case features that one reading of the log gives."""
    now = F.lit(as_of).cast("timestamp")
    gaps = log.select("case_id", "activity", "ts", milestone(F.col("activity")).alias("_m"), hours(F.lag("ts").over(in_case()), F.col("ts")).alias("_gap"), F.lag("activity").over(in_case()).alias("_before"))
    gaps = gaps.withColumn("_back", F.col("_m") < milestone(F.col("_before")))
    has = lambda name: F.max((F.col("activity") == name).cast("int"))
    count = lambda name: F.count_if(F.col("activity") == name)
    gap, last = F.col("_gap") / unit_hours, F.max(F.when(F.col("_m").isNotNull(), F.col("ts")))
    rounded = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return gaps.groupBy("case_id").agg(
        rounded(hours(F.min("ts"), F.max("ts")) / unit_hours).alias("total_duration"), rounded(hours(F.min("ts"), now) / unit_hours).alias("time_since_start"),
        rounded(F.avg(gap)).alias("avg_activity_duration"), rounded(F.max(gap)).alias("max_activity_duration"), rounded(F.min(gap)).alias("min_activity_duration"), rounded(F.stddev_pop(gap)).alias("std_activity_duration"),
        rounded(hours(F.min("ts"), last) / unit_hours).alias("time_to_last_milestone"), F.count("*").alias("event_count"), F.countDistinct("activity").alias("unique_activity_count"),
        count("OrderChanged").alias("order_change_count"), count("CreditBlock").alias("credit_block_count"), *(count(a).alias(f"count_{a}") for a in COUNTED),
        has("CreditBlock").alias("has_credit_block"), has("OrderChanged").alias("has_order_changes"), F.count_if("_back").alias("backward_flow_count"), F.coalesce(F.max("_m"), F.lit(0)).alias("current_stage"),
        F.greatest(has("CreditBlock") - has("CreditRelease"), F.lit(0)).alias("is_blocked"), rounded(hours(last, now) / 24).alias("days_in_current_stage"),
    )


def case_features_ext(log: DataFrame, as_of: str) -> DataFrame:
    """The inputs of the additive scores: age, idle time, pace, flags by words, loops, backtracks, progress and risk flags."""
    now, name = F.lit(as_of).cast("timestamp"), F.lower(F.regexp_replace("activity", "([a-z])([A-Z])", "$1_$2"))
    placed = log.select("case_id", "ts", name.alias("activity"), milestone(F.col("activity")).alias("_m"), F.dayofweek("ts").alias("_day"), "event_id")
    high = F.max("_m").over(in_case().rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("_back", F.col("_m") < high)
    any_of = lambda *words: F.max(reduce(lambda a, b: a | b, (F.col("activity").contains(w) for w in words)))
    grouped = placed.groupBy("case_id").agg(
        F.round(hours(F.min("ts"), now), 4).alias("case_age"), F.round(hours(F.max("ts"), now), 4).alias("idle_hours"), F.count("*").alias("event_count"), F.countDistinct("activity").alias("_distinct"),
        F.round(hours(F.min("ts"), F.max("ts")) / F.greatest(F.count("*") - 1, F.lit(1)), 4).alias("avg_gap_hours"), any_of("credit_block", "credit_hold").alias("_held"), any_of("credit_release").alias("_freed"),
        any_of("credit").alias("has_credit_check"), any_of("goods_issue").alias("has_goods_issued"), any_of("delivery").alias("has_delivery"), any_of("invoice").alias("has_invoice"), any_of("reject").alias("rejection_detected"),
        any_of("block").alias("block_detected"), any_of("cancel").alias("cancellation_detected"), F.count_if("_back").alias("backtrack_count"), F.countDistinct("_m").alias("_reached"), F.min_by("_day", F.struct("ts", "event_id")).alias("_day"),
    )
    loops = F.col("event_count") - F.col("_distinct")
    risks = F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("rejection_detected", "block_detected", "cancellation_detected")), F.when(loops > 0, F.lit("rework_detected")), F.when(F.col("idle_hours") > 168, F.lit("long_idle"))))
    return grouped.select(
        "case_id", "case_age", "idle_hours", "event_count", "avg_gap_hours", (F.col("_held") & ~F.col("_freed")).alias("has_credit_hold"), "has_credit_check", "has_goods_issued", "has_delivery", "has_invoice", "rejection_detected", "block_detected",
        (loops > 0).alias("has_rework"), loops.alias("loop_count"), "backtrack_count", F.col("_day").isin(1, 7).alias("is_weekend_start"), F.round(F.col("_reached") / len(MILESTONES), 4).alias("progress"),
        F.round(F.least(F.lit(1.0), F.col("_distinct") / 20 + loops / 20), 4).alias("complexity"), F.array_join(risks, ",").alias("risk_indicators"),
    )


Score = tuple[Column, Column]


def _score(parts: list[tuple[str, Column, Column]]) -> Score:
    """Probability and the factors that apply; parts: name, test, what it adds."""
    total = reduce(lambda a, b: a + b, (F.when(test, add).otherwise(0.0) for _, test, add in parts))
    factors = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test, _ in parts)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4), F.array_join(factors, ",")


def _late_delivery() -> Score:
    c = F.col
    return _score([
        ("case_age", c("case_age") > 72, F.least(c("case_age") / 336, F.lit(1.0)) * 0.25), ("low_progress", (c("progress") < 0.5) & (c("case_age") > 48), (1 - c("progress")) * 0.2),
        ("stalled", c("idle_hours") > 24, F.least(c("idle_hours") / 168, F.lit(1.0)) * 0.2), ("credit_hold", c("has_credit_hold"), F.lit(0.3)), ("rework", c("has_rework"), F.lit(0.1)),
        ("backtracks", c("backtrack_count") > 0, F.least(c("backtrack_count") * 0.1, F.lit(0.2))), ("weekend_start", c("is_weekend_start"), F.lit(0.05)), ("goods_issued", c("has_goods_issued"), F.lit(-0.3)),
        ("delivery_created", c("has_delivery") & ~c("has_goods_issued"), F.lit(-0.15)),
    ])


def _credit_hold() -> Score:
    c = F.col
    probability, factors = _score([
        ("no_credit_check", ~c("has_credit_check") & (c("event_count") > 2), F.lit(0.3)), ("high_complexity", c("complexity") > 0.5, c("complexity") * 0.2), ("rejection_history", c("rejection_detected"), F.lit(0.25)),
        ("block_history", c("block_detected"), F.lit(0.2)), ("credit_check_passed", c("has_credit_check"), F.lit(-0.4)), ("late_stage", c("has_goods_issued") | c("has_invoice"), F.lit(-0.3)),
    ])
    return F.when(c("has_credit_hold"), 1.0).otherwise(probability), F.when(c("has_credit_hold"), "credit_hold_active").otherwise(factors)


def _remaining_hours() -> Column:
    c, left = F.col, 1 - F.col("progress")
    pace = F.ceil(F.round(left * 7, 6)) * 3 * c("avg_gap_hours")
    base = F.when((c("event_count") > 1) & (c("avg_gap_hours") > 0), (120 * left + pace) / 2).otherwise(120 * left)
    base = base + F.when(c("has_credit_hold"), 48).otherwise(0)
    base = base * F.when(c("has_rework"), 1.2).otherwise(1.0) + c("backtrack_count") * 12
    return F.greatest(F.lit(0.0), F.when(c("progress") >= 0.95, F.least(base, F.lit(24.0))).otherwise(base))


def _completion_time() -> Score:
    return F.round(F.least(F.lit(1.0), _remaining_hours() / 336), 4), F.lit("")


def score_late_delivery(f: DataFrame) -> DataFrame:
    probability, factors = _late_delivery()
    return f.select("case_id", probability.alias("probability"), factors.alias("factors"))


def score_credit_hold(f: DataFrame) -> DataFrame:
    probability, factors = _credit_hold()
    return f.select("case_id", probability.alias("probability"), factors.alias("factors"))


def score_completion_time(f: DataFrame) -> DataFrame:
    """Remaining hours, and their risk on a scale of two weeks."""
    return f.select("case_id", F.round(_remaining_hours(), 2).alias("remaining_hours"), _completion_time()[0].alias("probability"))


def risk_level(p: Column) -> Column:
    return F.when(p >= 0.8, "critical").when(p >= 0.6, "high").when(p >= 0.4, "medium").when(p >= 0.2, "low").otherwise("minimal")


def predictions(f: DataFrame) -> DataFrame:
    """case_id, prediction_type, probability, factors of all three scores, from one pass over the features."""
    scores = {"late_delivery": _late_delivery(), "credit_hold": _credit_hold(), "completion_time": _completion_time()}
    rows = F.array(*(F.struct(F.lit(kind).alias("prediction_type"), p.alias("probability"), why.alias("factors")) for kind, (p, why) in scores.items()))
    return f.select("case_id", F.explode(rows).alias("r")).select("case_id", "r.*")


#: What each prediction counts for.
WEIGHTS = {"late_delivery": 0.4, "credit_hold": 0.35, "completion_time": 0.25}


def composite_risk(found: DataFrame) -> DataFrame:
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[F.col("prediction_type")]
    p = F.sum(F.col("probability") * weight) / F.sum(weight)
    return found.groupBy("case_id").agg(F.round(p * 100, 2).alias("risk_score"), F.max("probability").alias("highest")).withColumn("risk_level", risk_level(F.col("highest")))


def rank_by_risk(found: DataFrame, top: int = 50) -> DataFrame:
    return composite_risk(found).orderBy(F.desc("risk_score"), "case_id").limit(top)


def risk_distribution(found: DataFrame) -> DataFrame:
    return found.groupBy("prediction_type", risk_level(F.col("probability")).alias("risk_level")).agg(F.count("*").alias("n"), F.round(F.avg("probability"), 4).alias("avg_probability"))


def top_risk_factors(found: DataFrame, top: int = 10) -> DataFrame:
    named = found.where("factors <> ''").select(F.explode(F.split("factors", ",")).alias("factor"))
    return named.groupBy("factor").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "factor").limit(top)


def weighted_risk(found: DataFrame, sla_hours: float | None = None) -> DataFrame:
    """Only probabilities, and hours against an SLA where one is given; heuristics don't mix in.
    found: case_id, prediction_type, value, value_type (probability, ratio, raw, heuristic)."""
    v, kind = F.col("value"), F.col("value_type")
    raw = F.when((kind == "raw") & (F.col("prediction_type") == "completion_time"), F.least(F.lit(1.0), v / sla_hours)) if sla_hours else F.lit(None).cast("double")
    risk = F.when(kind.isin("probability", "ratio"), v).otherwise(raw)
    weight = F.coalesce(F.create_map(*(x for k, w in WEIGHTS.items() for x in (F.lit(k), F.lit(w))))[F.col("prediction_type")], F.lit(0.1))
    used = F.when(risk.isNotNull(), weight)
    score = F.coalesce(F.sum(risk * weight) / F.sum(used), F.lit(0.0))
    return found.groupBy("case_id").agg(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("risk_score"), F.count(used).alias("n_used"), (F.count("*") - F.count(used)).alias("n_excluded")).withColumn("risk_level", risk_level(F.col("risk_score")))


#: Prediction, alert, comparison, threshold, severity and minutes of rest. Rest is kept by severity too.
THRESHOLDS = [
    ("late_delivery", "late_delivery_risk", "gte", 0.7, "high", 60), ("late_delivery", "late_delivery_risk", "gte", 0.9, "critical", 30),
    ("credit_hold", "credit_hold_risk", "gte", 0.6, "medium", 60), ("credit_hold", "credit_hold_risk", "gte", 0.85, "high", 30),
]


def threshold_table(spark: SparkSession, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    return spark.createDataFrame(thresholds, "prediction_type string, alert_type string, comparison string, threshold double, severity string, cooldown_minutes int")


def threshold_hits(found: DataFrame, thresholds: list[tuple] = THRESHOLDS) -> DataFrame:
    """Predictions joined with the few thresholds that they pass."""
    return found.join(threshold_table(found.sparkSession, thresholds), "prediction_type").where(passed(F.col("probability"), F.col("comparison"), F.col("threshold")))


def threshold_alerts(hits: DataFrame, most: int = 10, ts: str = "ts", expiry_minutes: int | None = None) -> DataFrame:
    """Alerts after rest and cap: case_id, alert_type, severity, probability, ts (see alerting)."""
    return alert_events(hits, None, most, ts, expiry_minutes).select("case_id", "alert_type", "severity", "probability", "ts")


def alert_summary(alerts: DataFrame) -> DataFrame:
    grouped = alerts.groupingSets([["severity"], ["alert_type"]], "severity", "alert_type").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases"))
    return grouped.select(F.when(F.col("severity").isNull(), "type").otherwise("severity").alias("dimension"), F.coalesce("severity", "alert_type").alias("value"), "n", "n_cases")


#: What to do about a factor.
ADVICE = {
    "credit_hold": "Review the credit hold", "credit_hold_active": "Review the credit hold", "stalled": "Contact the owner of the case", "low_progress": "Check the open steps", "case_age": "Expedite the order",
    "rework": "Find the cause of the repeats", "backtracks": "Find the cause of the steps back", "no_credit_check": "Run the credit check", "rejection_history": "Clear the rejections", "block_history": "Clear the blocks",
}


def recommendations(found: DataFrame, most: int = 3) -> DataFrame:
    """Advice for the first factors of each prediction."""
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    listed = F.slice(F.array_compact(F.transform(F.split("factors", ","), lambda x: advice[x])), 1, most)
    return found.select("case_id", "prediction_type", F.array_join(listed, "; ").alias("recommendations"))


def case_summary(found: DataFrame, most: int = 5) -> DataFrame:
    """One row a case: its highest probability, how many predictions are high, and at most `most` different recommendations."""
    advice = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    every = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list(F.transform(F.split("factors", ","), lambda x: advice[x]))))))
    return found.groupBy("case_id").agg(F.max("probability").alias("highest"), F.count_if(F.col("probability") >= 0.6).alias("n_high"), F.array_join(F.slice(every, 1, most), "; ").alias("recommendations"))


#: Risk indicators of a case and when they hold.
INDICATORS = [
    ("case_age_high", "case_age > 168"), ("stalled_case", "idle_hours > 48"), ("credit_hold", "has_credit_hold"), ("rework_detected", "has_rework"), ("excessive_loops", "loop_count > 2"), ("process_backtrack", "backtrack_count > 0"),
    ("slow_progress", "progress > 0 and progress < 0.3 and case_age > 72"), ("high_handoffs", "resource_changes > 5"), ("weekend_processing", "is_weekend_start"), ("rejection_detected", "rejection_detected"), ("block_detected", "block_detected"),
]


def case_features_full(log: DataFrame, as_of: str) -> DataFrame:
    """case_features_ext with the hour of the start, resources and hand-offs, the last two activities, and all indicators.
    All parts are grouped by the case, so they meet where they are."""
    from .documents import handoffs, recent_activities

    start = log.groupBy("case_id").agg(F.hour(F.min("ts")).alias("start_hour"))
    wide = case_features_ext(log, as_of).drop("risk_indicators").join(start, "case_id").join(handoffs(log), "case_id").join(recent_activities(log), "case_id")
    return wide.withColumn("risk_indicators", F.concat_ws(",", *(F.when(F.expr(test), F.lit(name)) for name, test in INDICATORS)))
