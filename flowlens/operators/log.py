"""Event logs: counts, variants, directly-follows graphs, durations, bottlenecks and rework.

A log has case_id, activity, ts and event_id; ties in time are in the order of event_id. Windows are per case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .quantiles import moments, percentiles, percentiles_of, sketched, value_counts, with_percentiles


def in_case() -> WindowSpec:
    return Window.partitionBy("case_id").orderBy("ts", "event_id", "activity")


def hours(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def with_share(df: DataFrame, n: str = "n", to: str = "share") -> DataFrame:
    """The share of n in its total: one row of totals is joined, no window over the whole table."""
    total = df.agg(F.sum(n).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(to, F.round(F.col(n) / F.col("_total"), 6)).drop("_total")


def steps(log: DataFrame) -> DataFrame:
    """Each event with the next one of its case and the hours to it; last events have none."""
    return log.select("case_id", "activity", "ts", "event_id", F.lead("activity").over(in_case()).alias("to_activity"), F.lead("ts").over(in_case()).alias("to_ts")).withColumn("hours", hours(F.col("ts"), F.col("to_ts")))


def positions(log: DataFrame) -> DataFrame:
    return log.withColumn("position", F.row_number().over(in_case()) - 1)


def sequences(log: DataFrame) -> DataFrame:
    """case_id, activities in order, first and last time."""
    events = F.array_sort(F.collect_list(F.struct("ts", "event_id", "activity")))
    return log.groupBy("case_id").agg(events.alias("_e"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("case_id", F.col("_e.activity").alias("activities"), "first_ts", "last_ts")


def log_stats(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("n_events"), F.countDistinct("case_id").alias("n_cases"), F.countDistinct("activity").alias("n_activities"),
        F.countDistinct("resource").alias("n_resources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def activity_frequency(log: DataFrame) -> DataFrame:
    return with_share(log.groupBy("activity").agg(F.count("*").alias("n")))


def _edge_activities(log: DataFrame, pick) -> DataFrame:
    of_case = log.groupBy("case_id").agg(pick("activity", F.struct("ts", "event_id", "activity")).alias("activity"))
    return of_case.groupBy("activity").agg(F.count("*").alias("n"))


def start_activities(log: DataFrame) -> DataFrame:
    return _edge_activities(log, F.min_by)


def end_activities(log: DataFrame) -> DataFrame:
    return _edge_activities(log, F.max_by)


def variants(log: DataFrame) -> DataFrame:
    """variant, n, share of every sequence of activities."""
    named = sequences(log).select(F.array_join("activities", " -> ").alias("variant"))
    return with_share(named.groupBy("variant").agg(F.count("*").alias("n")))


def process_variants(log: DataFrame, top: int = 20) -> DataFrame:
    """The `top` most frequent variants with their rank and running share."""
    best = variants(log).orderBy(F.desc("n"), "variant").limit(top)
    rank = Window.orderBy(F.desc("n"), "variant")  # over the few rows of the report
    return best.withColumn("rank", F.row_number().over(rank)).withColumn("coverage", F.round(F.sum("share").over(rank.rowsBetween(Window.unboundedPreceding, 0)), 4))


def case_durations(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.count("*").alias("n_events"), F.round(hours(F.min("ts"), F.max("ts")), 4).alias("duration_hours"))


def case_duration_summary(log: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Numbers over all cases; the median is exact, or with `accuracy` from a sketch."""
    h, cases = F.col("duration_hours"), case_durations(log)
    named = {"avg_hours": F.avg(h), "median_hours": None, "min_hours": F.min(h), "max_hours": F.max(h), "std_hours": F.coalesce(F.stddev_samp(h), F.lit(0.0))}
    if accuracy is not None:
        named["median_hours"] = sketched(h, 0.5, accuracy)
    whole = cases.agg(F.count("*").alias("n_cases"), *(c.alias(n) for n, c in named.items() if c is not None), F.round(F.avg("n_events"), 4).alias("avg_events"))
    if accuracy is None:
        whole = with_percentiles(whole, value_counts(cases, [], "duration_hours"), [], {"median_hours": 0.5})
    return whole.select("n_cases", *(F.round(n, 3).alias(n) if n not in ("min_hours", "max_hours") else n for n in named), "avg_events")


def directly_follows(log: DataFrame, main_share: float = 0.1) -> DataFrame:
    edges = steps(log).where("to_activity is not null").groupBy(F.col("activity").alias("from_activity"), "to_activity").agg(
        F.count("*").alias("n"), F.round(F.avg("hours"), 4).alias("avg_hours"), F.round(F.min("hours"), 4).alias("min_hours"), F.round(F.max("hours"), 4).alias("max_hours")
    )
    return with_share(edges).withColumn("is_main_path", F.col("share") > main_share)


def transition_filter(edges: DataFrame, min_share: float = 0.0, main_path: bool = False) -> DataFrame:
    return edges.where(F.col("is_main_path")) if main_path else edges.where(F.col("share") >= min_share)


EDGE = ["from_activity", "to_activity"]


def timed_edges(log: DataFrame) -> DataFrame:
    return steps(log).where("to_activity is not null and hours >= 0").withColumnRenamed("activity", "from_activity")


def transition_metrics(log: DataFrame, accuracy: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Times of each edge; percentiles are exact, or with `accuracy` from sketches. counts: of timed_edges(), if known."""
    h, shares = F.col("hours"), {"p50_hours": 0.5, "p85_hours": 0.85, "p95_hours": 0.95}
    if accuracy is None:
        counts = value_counts(timed_edges(log), EDGE, "hours") if counts is None else counts
        grouped = moments(counts, EDGE).select(*EDGE, "n", *(F.col(c).alias(f"{c}_hours") for c in ("mean", "std", "min", "max")))
        named = with_percentiles(grouped, counts, EDGE, shares)
    else:
        rough = [sketched(h, share, accuracy).alias(name) for name, share in shares.items()]
        named = timed_edges(log).groupBy(*EDGE).agg(F.count("*").alias("n"), F.avg(h).alias("mean_hours"), F.coalesce(F.stddev_samp(h), F.lit(0.0)).alias("std_hours"), F.min(h).alias("min_hours"), F.max(h).alias("max_hours"), *rough)
    return named.select(*(F.round(c, 4).alias(c) if c.endswith("_hours") else c for c in named.columns))


def bottlenecks(log: DataFrame, medium: float = 0.5, slow: float = 0.85, use_global: bool = True, min_samples: int = 3, accuracy: int | None = None) -> DataFrame:
    """transition_metrics with a level by mean against the percentiles of all durations, or of the edge's own."""
    counts = value_counts(timed_edges(log), EDGE, "hours") if accuracy is None else None
    edges = transition_metrics(log, accuracy, counts)
    if use_global:
        if counts is not None:
            cuts = percentiles_of(counts.groupBy("_g", "_v").agg(F.sum("_n").alias("_n")), [], [medium, slow], "_p")
        else:
            cuts = timed_edges(log).agg(sketched(F.col("hours"), [medium, slow], accuracy).alias("_p"))
        wide = edges.join(F.broadcast(cuts.select(F.round(F.get("_p", F.lit(0)), 4).alias("_medium"), F.round(F.get("_p", F.lit(1)), 4).alias("_slow"))), how="left")
    else:
        wide = edges.withColumn("_medium", F.col("p50_hours")).withColumn("_slow", F.col("p85_hours"))
    mean = F.col("mean_hours")
    level = F.when(F.col("n") < min_samples, "medium").when(mean <= F.col("_medium"), "fast").when(mean <= F.col("_slow"), "medium").otherwise("slow")
    return wide.withColumn("level", level).drop("_medium", "_slow")


def bottleneck_summary(log: DataFrame) -> DataFrame:
    levels = bottlenecks(log)
    slow = F.col("level") == "slow"
    worst = F.max(F.when(slow, F.struct("mean_hours", "from_activity", "to_activity")))
    return levels.agg(
        F.count("*").alias("n_transitions"), F.count_if(F.col("level") == "fast").alias("n_fast"), F.count_if(F.col("level") == "medium").alias("n_medium"), F.count_if(slow).alias("n_slow"), worst.alias("_w")
    ).select("n_transitions", "n_fast", "n_medium", "n_slow", F.concat_ws(" -> ", "_w.from_activity", "_w.to_activity").alias("worst"))


def activity_bottlenecks(log: DataFrame) -> DataFrame:
    """Mean hours to the next event of each activity, and a severity by the percentiles of the positive means."""
    means = log.select("activity").distinct().join(
        steps(log).where("hours >= 0").groupBy("activity").agg(F.round(F.avg("hours"), 6).alias("avg_hours")), "activity", "left"
    )
    cuts = percentiles(means.where("avg_hours > 0"), [], "avg_hours", [0.5, 0.75, 0.9], "_p")
    d = F.col("avg_hours")
    severity = F.when(d.isNull() | (d <= 0), "none").when(d >= F.col("_p")[2], "critical").when(d >= F.col("_p")[1], "high").when(d >= F.col("_p")[0], "medium").otherwise("low")
    return means.join(F.broadcast(cuts), how="left").select("activity", F.round("avg_hours", 4).alias("avg_hours"), severity.alias("severity"))


#: Hours up to which a step between document categories is no, a low or a medium bottleneck.
STEP_LIMITS = {"C_to_J": (24, 72), "J_to_M": (24, 72)}


def flow_step_timings(flow: DataFrame) -> DataFrame:
    """Hours between the documents of a flow edge by category pair; flow: vbelv, vbtyp_v, vbeln, vbtyp_n, erdat.
    The thresholds are looked up by the category pair itself, so they do apply."""
    source = flow.select(F.col("vbeln").alias("_doc"), F.col("erdat").alias("_from")).distinct()
    timed = flow.join(source, F.col("vbelv") == F.col("_doc")).withColumn("hours", F.datediff("erdat", "_from") * 24.0)
    step = F.concat(F.col("vbtyp_v"), F.lit("_to_"), F.col("vbtyp_n"))
    grouped = timed.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("hours"), 4).alias("avg_hours"), F.min("hours").alias("min_hours"), F.max("hours").alias("max_hours"))
    limits = F.create_map(*(x for k, v in STEP_LIMITS.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))))
    own = F.coalesce(limits[F.col("step")], F.array(F.lit(24), F.lit(72)))
    return grouped.withColumn("severity", F.when(F.col("avg_hours") <= own[0], "low").when(F.col("avg_hours") <= own[1], "medium").otherwise("high"))


def rework_stats(log: DataFrame) -> DataFrame:
    """Per activity: cases that repeat it, mean and largest number of executions there, repeats right after itself."""
    counts = log.groupBy("case_id", "activity").agg(F.count("*").alias("_n"))
    repeats = counts.groupBy("activity").agg(
        F.count("*").alias("n_cases"), F.count_if(F.col("_n") > 1).alias("n_repeat_cases"), F.round(F.coalesce(F.avg(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0.0)), 4).alias("avg_repeats"), F.max("_n").alias("max_repeats")
    )
    direct = steps(log).where("activity = to_activity").groupBy("activity").agg(F.count("*").alias("n_direct"))
    return repeats.join(direct, "activity", "left").withColumn("n_direct", F.coalesce("n_direct", F.lit(0)))


def duration_outliers(log: DataFrame, sigmas: float = 2.0) -> DataFrame:
    cases = case_durations(log)
    whole = cases.agg((F.avg("duration_hours") + sigmas * F.stddev_samp("duration_hours")).alias("_limit"))
    return cases.crossJoin(F.broadcast(whole)).where("duration_hours > _limit").drop("_limit")


def resource_workload(log: DataFrame) -> DataFrame:
    return with_share(log.groupBy("resource").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("n_cases")))


def resource_versatility(log: DataFrame) -> DataFrame:
    """How many resources carry out how many activities."""
    return log.groupBy("resource").agg(F.countDistinct("activity").alias("n_activities")).groupBy("n_activities").agg(F.count("*").alias("n_resources"))


def attribute_distribution(df: DataFrame, column: str) -> DataFrame:
    return with_share(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")))


def precedence_issues(log: DataFrame, a: str, b: str) -> DataFrame:
    """Cases with b but not a, with b before a, and with the first of both by one resource."""
    only = lambda x, c: F.when(F.col("activity") == x, F.col(c))
    cases = log.groupBy("case_id").agg(
        F.min(only(a, "ts")).alias("a_ts"), F.min(only(b, "ts")).alias("b_ts"),
        F.min(F.when(F.col("activity") == a, F.struct("ts", "event_id", "resource"))).alias("_a"), F.min(F.when(F.col("activity") == b, F.struct("ts", "event_id", "resource"))).alias("_b"),
    )
    return cases.agg(
        F.count_if(F.col("b_ts").isNotNull() & F.col("a_ts").isNull()).alias("b_without_a"), F.count_if(F.col("b_ts") < F.col("a_ts")).alias("b_before_a"),
        F.count_if(F.col("_a.resource") == F.col("_b.resource")).alias("same_resource"),
    )
