"""Outcome statistics of groups of documents: baselines, effect sizes, cards and coverage.

Moments are one groupBy; tails of the t and normal distributions are computed for the few rows that result.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quantiles import moments, sketched, value_counts, with_percentiles

METRICS = ["order_to_delivery_days", "delivery_delay_days", "invoice_lag_days", "order_to_invoice_days"]
RATES = ["delay_probability", "partial_delivery_rate", "return_rate"]
#: Words of a return in a text.
RETURN_WORDS = ["return", "rma", "credit memo", "refund", "defective", "damaged"]


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        c = 1 + term / c or 1e-300
        value *= c * d
        if abs(1 - c * d) < 1e-12:
            break
    return front * (value - 1)


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 and math.isfinite(t) else float("nan")


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_quantile(df: float, alpha: float = 0.05) -> float:
    """The point that |t| passes with probability alpha, by bisection."""
    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > alpha else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    known = {x: t_quantile(x) for x in df.unique()}
    return df.map(known)


@F.pandas_udf(T.DoubleType())
def z_p_value(z: pd.Series) -> pd.Series:
    return z.map(normal_two_sided)


#: Flow categories of returns.
RETURN_CATEGORIES = ["H", "K", "R"]


def has_return(text: Column, reason: Column | None = None, categories: Column | None = None) -> Column:
    """Whether there is a reason for rejection or return, a document of a return category (an array) or a word of returns."""
    words = reduce(lambda a, b: a | b, (F.lower(text).contains(w) for w in RETURN_WORDS))
    tests = [words, *([F.coalesce(reason, F.lit("")) != ""] if reason is not None else []), *([F.arrays_overlap(categories, F.array(*map(F.lit, RETURN_CATEGORIES)))] if categories is not None else [])]
    return reduce(lambda a, b: a | b, (F.coalesce(t, F.lit(False)) for t in tests))


def long_metrics(docs: DataFrame, *keys: str) -> DataFrame:
    """(keys, metric, value) of the metrics that are present."""
    pairs = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    return docs.selectExpr(*keys, f"stack({len(METRICS)}, {pairs}) as (metric, value)").where("value is not null")


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    v = F.col("value")
    return rows.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def outcome_baseline(docs: DataFrame, least: int = 5, accuracy: int | None = None) -> DataFrame:
    """Numbers of each metric; the median is exact, or with `accuracy` from a sketch."""
    rows = long_metrics(docs)
    if accuracy is None:
        counts = value_counts(rows, ["metric"], "value")
        found = with_percentiles(moments(counts, ["metric"]), counts, ["metric"], {"median": 0.5})
    else:
        found = _moments(rows).join(rows.groupBy("metric").agg(sketched(F.col("value"), 0.5, accuracy).alias("median")), "metric")
    found = found.where(F.col("n") >= least)
    return found.select("metric", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "median", "min", "max")))


def outcome_rates(docs: DataFrame, delay_days: int = 7) -> DataFrame:
    """Share of late orders, of orders in parts, and of returns, each with its counts and whether data are missing."""
    late = F.col("delivery_delay_days")
    counts = docs.agg(
        F.count_if(late > delay_days).alias("a1"), F.count(late).alias("b1"), F.count_if(F.col("n_deliveries") > 1).alias("a2"), F.count_if(F.col("n_deliveries") >= 1).alias("b2"),
        F.count_if("is_return").alias("a3"), F.count("*").alias("b3"),
    )
    rows = counts.selectExpr("stack(3, " + ", ".join(f"'{name}', a{i}, b{i}" for i, name in enumerate(RATES, 1)) + ") as (metric, n_hits, n_total)")
    return rows.withColumn("rate", F.round(F.when(F.col("n_total") > 0, F.col("n_hits") / F.col("n_total")), 6)).withColumn("insufficient_data", F.col("n_total") == 0)


def effect_label(size: Column) -> Column:
    return F.when(F.abs(size) < 0.2, "negligible").when(F.abs(size) < 0.5, "small").when(F.abs(size) < 0.8, "medium").otherwise("large")


def cluster_effects(docs: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Mean difference of each cluster to all documents per metric: pooled Cohen's d, t test and interval."""
    whole = _moments(long_metrics(docs)).select("metric", F.col("n").alias("n_baseline"), F.col("mean").alias("baseline_value"), F.col("std").alias("_s2")).where("n_baseline >= 5")
    own = _moments(long_metrics(docs, cluster), cluster).where("n >= 2").select(cluster, "metric", F.col("n").alias("n_cluster"), F.col("mean").alias("cluster_value"), F.col("std").alias("_s1"))
    c = F.col
    df = c("n_cluster") + c("n_baseline") - 2
    pooled = F.sqrt(((c("n_baseline") - 1) * c("_s2") ** 2 + (c("n_cluster") - 1) * c("_s1") ** 2) / df)
    wide = own.join(F.broadcast(whole), "metric").withColumns({"difference": c("cluster_value") - c("baseline_value"), "_pooled": pooled, "_df": df.cast("double")})
    wide = wide.withColumns({
        "effect_size": F.when(c("_pooled") > 0, c("difference") / c("_pooled")).otherwise(0.0), "_t": F.when(c("_pooled") > 0, c("difference") / (c("_pooled") * F.sqrt(1 / c("n_cluster") + 1 / c("n_baseline")))).otherwise(0.0),
        "_se": F.sqrt(c("_s1") ** 2 / c("n_cluster") + c("_s2") ** 2 / c("n_baseline")),
    })
    return wide.select(
        cluster, "metric", "n_cluster", "n_baseline", *(F.round(x, 4).alias(x) for x in ("cluster_value", "baseline_value", "difference", "effect_size")), effect_label(c("effect_size")).alias("effect"),
        F.round(c("difference") - t_critical(c("_df")) * c("_se"), 4).alias("ci_lower"), F.round(c("difference") + t_critical(c("_df")) * c("_se"), 4).alias("ci_upper"), F.round(t_p_value(c("_t"), c("_df")), 6).alias("p_value"),
    ).withColumn("is_significant", F.col("p_value") < 0.05)


def cluster_rate_effects(docs: DataFrame, flag: Column, metric: str, cluster: str = "cluster") -> DataFrame:
    """Difference of a rate of each cluster to all documents: Cohen's h, z test and interval."""
    rows = docs.select(cluster, flag.cast("int").alias("_f")).where("_f is not null")
    own = rows.groupBy(cluster).agg(F.count("*").alias("n_cluster"), F.avg("_f").alias("cluster_value"))
    wide = own.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n_baseline"), F.avg("_f").alias("baseline_value"))))
    a, b, n, m = F.col("cluster_value"), F.col("baseline_value"), F.col("n_cluster"), F.col("n_baseline")
    size = 2 * F.asin(F.sqrt(a)) - 2 * F.asin(F.sqrt(b))
    pooled = (a * n + b * m) / (n + m)
    spread = F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    se = F.sqrt(a * (1 - a) / n + b * (1 - b) / m)
    p = F.when(spread > 0, z_p_value(F.coalesce((a - b) / F.when(spread > 0, spread), F.lit(0.0))))
    z = 1.959963984540054
    return wide.select(cluster, F.lit(metric).alias("metric"), "n_cluster", "n_baseline", F.round(a, 4).alias("cluster_value"), F.round(b, 4).alias("baseline_value"), F.round(a - b, 4).alias("difference"), F.round(size, 4).alias("effect_size"), effect_label(size).alias("effect"), F.round(a - b - z * se, 4).alias("ci_lower"), F.round(a - b + z * se, 4).alias("ci_upper"), F.round(p, 6).alias("p_value")).withColumn("is_significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def notable_clusters(effects: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Clusters with a significant effect that is medium or large, and a sentence on each."""
    strong = F.col("is_significant") & F.col("effect").isin("medium", "large")
    said = F.when(F.col("is_significant"), F.format_string("%s %s (%s)", F.when(F.col("difference") > 0, "higher").otherwise("lower"), F.col("metric"), F.col("effect")))
    return effects.groupBy(cluster).agg(F.bool_or(strong).alias("is_notable"), F.array_join(F.array_sort(F.collect_list(said)), ", ").alias("_s")).select(cluster, "is_notable", F.when(F.col("_s") == "", "no significant effect").otherwise(F.concat(F.lit("Shows "), "_s")).alias("summary"))


def cluster_info(docs: DataFrame, cluster: str = "cluster", text: str = "text") -> DataFrame:
    total = docs.agg(F.count("*").alias("_t"))
    own = docs.groupBy(cluster).agg(F.count("*").alias("n"), F.round(F.avg(F.length(text)), 2).alias("avg_length"))
    return own.crossJoin(F.broadcast(total)).select(cluster, "n", "avg_length", F.round(F.col("n") / F.col("_t") * 100, 2).alias("percent"))


def occurrence_by(docs: DataFrame, column: str, cluster: str = "cluster") -> DataFrame:
    return docs.groupBy(cluster, F.col(column).alias("value")).agg(F.count("*").alias("n"))


def evidence_coverage(docs: DataFrame, fields: list[str], cluster: str = "cluster") -> DataFrame:
    return docs.groupBy(cluster).agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(f).isNotNull().cast("int")), 4).alias(f"{f}_coverage") for f in fields))


#: What to keep in mind about a card.
CAVEATS = {
    "observational": "Observational analysis only; correlation does not imply causation.", "text_based": "Patterns based on text similarity; may not capture all relevant factors.",
    "small_sample": "Based on only %d documents; results may not generalize.", "no_significance": "No statistically significant effects detected.",
    "weak_effect": "Effect sizes are small; practical significance may be limited.", "missing_timing": "Timing data incomplete for %d%% of documents.",
}
SNIPPETS, KEYS = 3, 5


def _first_of(docs: DataFrame, cluster: str, order: list[Column], n: int, value: Column, name: str) -> DataFrame:
    """The values of the first n rows of each cluster, in order; n is small."""
    ranked = docs.select(cluster, value.alias("_v"), F.row_number().over(Window.partitionBy(cluster).orderBy(*order)).alias("_r")).where(F.col("_r") <= n)
    return ranked.groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("_r", "_v")))["_v"].alias(name))


def pattern_cards(docs: DataFrame, effects: DataFrame, cluster: str = "cluster", phrases: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """One card a cluster: a stable id (of the cluster and its five smallest keys), title, description, size, its first
    effect with lift, confidence and category, caveats, and snippets chosen by a seeded hash. Effects are joined by the
    cluster itself, so they reach their cards. phrases: cluster, rank, phrase."""
    c = F.col
    size = cluster_info(docs, cluster)
    timed = docs.groupBy(cluster).agg(F.round((1 - F.count("order_to_delivery_days") / F.count("*")) * 100, 0).cast("int").alias("_missing"), (F.count("order_to_delivery_days") < F.count("*") * 0.8).alias("_untimed"))
    place = F.array_position(F.array(*map(F.lit, METRICS)), c("metric"))
    first = F.min_by(F.struct("metric", "difference", "effect", "baseline_value", "cluster_value"), F.struct(place, c("metric")))
    strong = c("effect").isin("medium", "large")
    told = F.array_sort(F.collect_list(F.when(c("is_significant"), F.struct(place.alias("p"), F.format_string("These documents show significantly %s %s (%+.1f %s effect).", F.when(c("difference") > 0, "higher").otherwise("lower"), F.replace(c("metric"), F.lit("_"), F.lit(" ")), "difference", "effect").alias("t")))))
    best = effects.groupBy(cluster).agg(first.alias("_b"), F.count_if("is_significant").alias("n_significant"), F.count_if(strong).alias("n_large"), F.bool_or(c("is_significant") & strong).alias("_notable"), told.alias("_told"), F.count("*").alias("_n_effects"))
    keys = _first_of(docs, cluster, [c("doc_key")], KEYS, c("doc_key").cast("string"), "_keys")
    shown = _first_of(docs.where(F.length(F.trim("text")) > 50), cluster, [F.xxhash64(F.lit(seed), "doc_key"), c("doc_key")], SNIPPETS, F.substring(F.trim("text"), 1, 300), "snippets")
    wide = size.join(timed, cluster).join(best, cluster, "left").join(keys, cluster).join(shown, cluster, "left")
    if phrases is not None:
        named = phrases.where("rank <= 5").groupBy(cluster).agg(F.array_sort(F.collect_list(F.struct("rank", "phrase")))["phrase"].alias("_phrases"))
        wide = wide.join(named, cluster, "left")
    else:
        wide = wide.withColumn("_phrases", F.array().cast("array<string>"))
    zero, phrases_of = F.lit(0).cast("long"), F.coalesce("_phrases", F.array().cast("array<string>"))
    wide = wide.withColumns({"n_significant": F.coalesce("n_significant", zero), "n_large": F.coalesce("n_large", zero), "_phrases": phrases_of})
    confidence = F.round(0.4 * F.least(F.lit(1.0), c("n") / 100) + 0.3 * F.least(F.lit(1.0), c("n_significant") / 4) + 0.3 * F.least(F.lit(1.0), c("n_large") / 2), 2)
    joined = F.array_join(F.transform(F.slice("_phrases", 1, 3), F.initcap), " / ")
    title = F.when(F.size("_phrases") == 0, F.concat(F.lit("Pattern "), c(cluster).cast("string"))).when(F.length(joined) > 60, F.concat(F.substring(joined, 1, 57), F.lit("..."))).otherwise(joined)
    quoted = F.array_join(F.transform(F.slice("_phrases", 1, 3), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    parts = [
        F.when(F.size("_phrases") > 0, F.concat(F.lit("Documents in this cluster frequently contain "), quoted, F.lit("."))),
        F.when(c("n_significant") > 0, F.array_join(F.slice("_told", 1, 2)["t"], " ")).otherwise("No statistically significant timing differences from baseline."), F.format_string("Based on analysis of %d documents.", "n"),
    ]
    lift = F.when(c("_b.baseline_value") != 0, F.round(c("_b.cluster_value") / c("_b.baseline_value"), 3)).when(c("_b.cluster_value") == 0, 1.0)
    caveats = F.array_compact(F.array(
        F.lit(CAVEATS["observational"]), F.lit(CAVEATS["text_based"]), F.when(c("n") < 30, F.format_string(CAVEATS["small_sample"], "n")), F.when(c("n_significant") == 0, CAVEATS["no_significance"]),
        F.when((c("n_large") == 0) & (c("_n_effects") > 0), CAVEATS["weak_effect"]), F.when(c("_untimed"), F.format_string(CAVEATS["missing_timing"], "_missing")),
    ))
    return wide.select(
        cluster, F.concat(F.lit("PAT-"), F.upper(F.substring(F.sha2(F.concat(c(cluster).cast("string"), F.lit(":"), F.array_join("_keys", ":")), 256), 1, 8))).alias("card_id"), title.alias("title"), F.concat_ws(" ", *parts).alias("description"), "n", "percent",
        c("_b.metric").alias("metric"), c("_b.effect").alias("effect"), lift.alias("lift"), (lift.isNull() & c("_b").isNotNull()).alias("lift_undefined"), confidence.alias("confidence"),
        F.when(confidence >= 0.7, "HIGH").when(confidence >= 0.4, "MEDIUM").otherwise("LOW").alias("category"), F.coalesce("_notable", F.lit(False)).alias("is_notable"), "n_significant", "n_large", F.array_join(caveats, "|").alias("caveats"), "snippets",
    )


def report_summary(cards: DataFrame) -> DataFrame:
    return cards.agg(
        F.count("*").alias("n_cards"), F.count_if("is_notable").alias("n_notable"), F.count_if(F.col("category") == "HIGH").alias("n_high"), F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.sum("n").alias("n_documents"),
        F.sum("n_significant").alias("n_significant_effects"), F.sum("n_large").alias("n_large_effects"),
    )
