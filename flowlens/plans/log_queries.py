"""Queries over event logs, each with the same query as DuckDB text."""

from __future__ import annotations

from ..operators import log as L


_ORDER = "PARTITION BY case_id ORDER BY ts, event_id, activity"
_STEPS = f"SELECT case_id, activity, ts, event_id, lead(activity) OVER w AS to_activity, lead(ts) OVER w AS to_ts, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 3.6e9 AS hours FROM fx_event_log WINDOW w AS ({_ORDER})"
VIEWS = {
    "lg_steps": _STEPS,
    "lg_edges": "SELECT * FROM lg_steps WHERE to_activity IS NOT NULL AND hours >= 0",
    "lg_cases": "SELECT case_id, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 4) AS duration_hours FROM fx_event_log GROUP BY case_id",
    "lg_sequences": "SELECT case_id, list(activity ORDER BY ts, event_id, activity) AS activities FROM fx_event_log GROUP BY case_id",
    "lg_variants": "SELECT variant, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT array_to_string(activities, ' -> ') AS variant, count(*) AS n FROM lg_sequences GROUP BY 1)",
    "lg_metrics": """SELECT activity AS from_activity, to_activity, count(*) AS n, round(avg(hours), 4) AS mean_hours, round(coalesce(stddev_samp(hours), 0), 4) AS std_hours, round(min(hours), 4) AS min_hours,
        round(max(hours), 4) AS max_hours, round(quantile_cont(hours, 0.5), 4) AS p50_hours, round(quantile_cont(hours, 0.85), 4) AS p85_hours, round(quantile_cont(hours, 0.95), 4) AS p95_hours FROM lg_edges GROUP BY ALL""",
    "lg_follows": """SELECT *, round(n / sum(n) OVER (), 6) AS share, round(n / sum(n) OVER (), 6) > 0.1 AS is_main_path FROM (SELECT activity AS from_activity, to_activity, count(*) AS n, round(avg(hours), 4) AS avg_hours,
        round(min(hours), 4) AS min_hours, round(max(hours), 4) AS max_hours FROM lg_steps WHERE to_activity IS NOT NULL GROUP BY ALL)""",
    "lg_levels": """SELECT m.*, CASE WHEN n < 3 THEN 'medium' WHEN mean_hours <= g.p50 THEN 'fast' WHEN mean_hours <= g.p85 THEN 'medium' ELSE 'slow' END AS level
        FROM lg_metrics m, (SELECT round(quantile_cont(hours, 0.5), 4) AS p50, round(quantile_cont(hours, 0.85), 4) AS p85 FROM lg_edges) g""",
    "lg_means": "SELECT a.activity, m.avg_hours FROM (SELECT DISTINCT activity FROM fx_event_log) a LEFT JOIN (SELECT activity, round(avg(hours), 6) AS avg_hours FROM lg_steps WHERE hours >= 0 GROUP BY activity) m USING (activity)",
}


def share(column: str, source: str = "fx_event_log", to: str | None = None) -> str:
    return f"SELECT {to or column}, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT {column} AS {to or column}, count(*) AS n FROM {source} GROUP BY 1)"


QUERIES = {
    "log_stats": (lambda t: L.log_stats(t.event_log()), "SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_event_log"),
    "activity_frequency": (lambda t: L.activity_frequency(t.event_log()), share("activity")),
    "start_activities": (lambda t: L.start_activities(t.event_log()), "SELECT activities[1] AS activity, count(*) AS n FROM lg_sequences GROUP BY 1"),
    "end_activities": (lambda t: L.end_activities(t.event_log()), "SELECT activities[-1] AS activity, count(*) AS n FROM lg_sequences GROUP BY 1"),
    "process_variants": (lambda t: L.process_variants(t.o2c_clean_log()), """WITH v AS (SELECT variant, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT array_to_string(activities, ' -> ') AS variant, count(*) AS n FROM
        (SELECT case_id, list(activity ORDER BY ts, event_id, activity) AS activities FROM fx_o2c_clean_log GROUP BY case_id) GROUP BY 1)), b AS (SELECT *, row_number() OVER (ORDER BY n DESC, variant) AS rank FROM v)
        SELECT variant, n, share, CAST(rank AS INT) AS rank, round(sum(share) OVER (ORDER BY rank), 4) AS coverage FROM b WHERE rank <= 20"""),
    "all_variants": (lambda t: L.variants(t.event_log()), "SELECT * FROM lg_variants"),
    "case_durations": (lambda t: L.case_durations(t.event_log()), "SELECT * FROM lg_cases"),
    "case_duration_summary": (lambda t: L.case_duration_summary(t.event_log()), """SELECT count(*) AS n_cases, round(avg(duration_hours), 3) AS avg_hours, round(quantile_cont(duration_hours, 0.5), 3) AS median_hours, min(duration_hours) AS min_hours,
        max(duration_hours) AS max_hours, round(coalesce(stddev_samp(duration_hours), 0), 3) AS std_hours, round(avg(n_events), 4) AS avg_events FROM lg_cases"""),
    "directly_follows": (lambda t: L.directly_follows(t.event_log()), "SELECT * FROM lg_follows"),
    "transition_filter": (lambda t: L.transition_filter(L.directly_follows(t.event_log()), 0.03), "SELECT * FROM lg_follows WHERE share >= 0.03"),
    "main_path": (lambda t: L.transition_filter(L.directly_follows(t.event_log()), main_path=True), "SELECT * FROM lg_follows WHERE is_main_path"),
    "transition_metrics": (lambda t: L.transition_metrics(t.event_log()), "SELECT * FROM lg_metrics"),
    "bottlenecks": (lambda t: L.bottlenecks(t.event_log()), "SELECT * FROM lg_levels"),
    "bottlenecks_own": (lambda t: L.bottlenecks(t.event_log(), use_global=False), "SELECT *, CASE WHEN n < 3 THEN 'medium' WHEN mean_hours <= p50_hours THEN 'fast' WHEN mean_hours <= p85_hours THEN 'medium' ELSE 'slow' END AS level FROM lg_metrics"),
    "bottleneck_summary": (lambda t: L.bottleneck_summary(t.event_log()), """SELECT count(*) AS n_transitions, count(*) FILTER (level = 'fast') AS n_fast, count(*) FILTER (level = 'medium') AS n_medium, count(*) FILTER (level = 'slow') AS n_slow,
        coalesce((SELECT from_activity || ' -> ' || to_activity FROM lg_levels WHERE level = 'slow' ORDER BY mean_hours DESC, from_activity DESC, to_activity DESC LIMIT 1), '') AS worst FROM lg_levels"""),
    "activity_bottlenecks": (lambda t: L.activity_bottlenecks(t.event_log()), """SELECT activity, round(avg_hours, 4) AS avg_hours, CASE WHEN avg_hours IS NULL OR avg_hours <= 0 THEN 'none' WHEN avg_hours >= p90 THEN 'critical' WHEN avg_hours >= p75 THEN 'high'
        WHEN avg_hours >= p50 THEN 'medium' ELSE 'low' END AS severity FROM lg_means, (SELECT quantile_cont(avg_hours, 0.5) AS p50, quantile_cont(avg_hours, 0.75) AS p75, quantile_cont(avg_hours, 0.9) AS p90 FROM lg_means WHERE avg_hours > 0)"""),
    "flow_step_timings": (lambda t: L.flow_step_timings(t.doc_flow()), """SELECT *, CASE WHEN avg_hours <= 24 THEN 'low' WHEN avg_hours <= 72 THEN 'medium' ELSE 'high' END AS severity FROM (SELECT f.vbtyp_v || '_to_' || f.vbtyp_n AS step, count(*) AS n,
        round(avg((f.erdat - s.erdat) * 24.0), 4) AS avg_hours, CAST(min((f.erdat - s.erdat) * 24.0) AS DOUBLE) AS min_hours, CAST(max((f.erdat - s.erdat) * 24.0) AS DOUBLE) AS max_hours
        FROM fx_doc_flow f JOIN (SELECT DISTINCT vbeln, erdat FROM fx_doc_flow) s ON f.vbelv = s.vbeln GROUP BY 1)"""),
    "rework_stats": (lambda t: L.rework_stats(t.event_log()), """WITH c AS (SELECT case_id, activity, count(*) AS n FROM fx_event_log GROUP BY ALL), d AS (SELECT activity, count(*) AS n_direct FROM lg_steps WHERE activity = to_activity GROUP BY 1)
        SELECT c.activity, count(*) AS n_cases, count(*) FILTER (n > 1) AS n_repeat_cases, round(coalesce(avg(n) FILTER (n > 1), 0), 4) AS avg_repeats, max(n) AS max_repeats, coalesce(max(n_direct), 0) AS n_direct FROM c LEFT JOIN d USING (activity) GROUP BY c.activity"""),
    "duration_outliers": (lambda t: L.duration_outliers(t.event_log()), "SELECT * FROM lg_cases WHERE duration_hours > (SELECT avg(duration_hours) + 2 * stddev_samp(duration_hours) FROM lg_cases)"),
    "resource_workload": (lambda t: L.resource_workload(t.event_log()), "SELECT resource, n, n_cases, round(n / sum(n) OVER (), 6) AS share FROM (SELECT resource, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM fx_event_log GROUP BY 1)"),
    "resource_versatility": (lambda t: L.resource_versatility(t.event_log()), "SELECT n_activities, count(*) AS n_resources FROM (SELECT resource, count(DISTINCT activity) AS n_activities FROM fx_event_log GROUP BY 1) GROUP BY 1"),
    "attribute_distribution": (lambda t: L.attribute_distribution(t.orders(), "auart"), share("auart", "fx_orders", "value")),
    "precedence_issues": (lambda t: L.precedence_issues(t.event_log(), "signup", "purchase"), """SELECT count(*) FILTER (b_ts IS NOT NULL AND a_ts IS NULL) AS b_without_a, count(*) FILTER (b_ts < a_ts) AS b_before_a, count(*) FILTER (a_r = b_r) AS same_resource FROM
        (SELECT case_id, min(ts) FILTER (activity = 'signup') AS a_ts, min(ts) FILTER (activity = 'purchase') AS b_ts, arg_min(resource, ts) FILTER (activity = 'signup') AS a_r, arg_min(resource, ts) FILTER (activity = 'purchase') AS b_r FROM fx_event_log GROUP BY 1)"""),
}


