"""Queries on texts of documents, the risk of documents, alerts and process context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as C
from ..operators import documents as D
from ..operators import features as R
from ..sources.fixtures import AS_OF
from .feature_queries import VIEWS as FEATURES

RISK_AS_OF = "1998-01-10"
_PLACE = "CASE level WHEN 'header' THEN 0 WHEN 'item' THEN 1 ELSE 2 END"
_LEVEL4 = "CASE WHEN {p} >= 0.9 THEN 'critical' WHEN {p} >= 0.7 THEN 'high' WHEN {p} >= 0.4 THEN 'medium' ELSE 'low' END"
_SUM = lambda base, parts: f"round(greatest(0.0, least(1.0, {base} + " + " + ".join(f"CASE WHEN {t} THEN {a} ELSE 0 END" for _, t, a in parts) + ")), 4)"
_WHY = lambda parts: "concat_ws(',', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t, _ in parts) + ")"
_LATE = [
    ("high_order_value", "v > 100000", 0.15), ("medium_order_value", "v > 50000 AND v <= 100000", 0.08), ("no_downstream_docs", "flow = 0", 0.2), ("partial_document_flow", "flow > 0 AND flow < 3", 0.1),
    ("pending_goods_issue", "pending", 0.15), ("order_age", f"DATE '{RISK_AS_OF}' - erdat > 14", 0.12), ("regional_risk", "vkorg IN ('0012', '0013')", -0.1),
]
_CREDIT = [
    ("exceptionally_high_value", "v > 200000", 0.25), ("high_value_order", "v > 100000 AND v <= 200000", 0.15), ("customer_credit_history", "digit < 2", 0.2), ("customer_credit_standing", "digit > 7", -0.1),
    ("order_type_risk", "auart = 'SO'", 0.1),
]
_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
_SEARCH = r"""SELECT doc_key, n_matches, round(n_matches / n_words, 6) AS score, CASE WHEN st > 1 THEN '...' ELSE '' END || substr(text, st, size) || CASE WHEN st + size <= length(text) THEN '...' ELSE '' END AS snippet FROM (
    SELECT *, greatest(strpos(text, m) - 50, 1) AS st, length(m) + 100 AS size FROM (SELECT {key} AS doc_key, text, regexp_extract(text, '(?i){pattern}') AS m, CAST(len(regexp_extract_all(text, '(?i){pattern}')) AS INT) AS n_matches,
    len(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+')) AS n_words FROM {table} WHERE regexp_matches(text, '(?i){pattern}') {where})) ORDER BY score DESC, doc_key LIMIT 200"""
VIEWS = FEATURES | {
    "dc_flow": f"""SELECT o.*, CAST(netwr AS DOUBLE) AS v, coalesce(nd, 0) + coalesce(ni, 0) AS flow, nd > 0 AS delivered, ni > 0 AS billed, d.actual_gi IS NULL AND nd > 0 AS pending, list_sum([ascii(x) for x in string_split(kunnr, '')]) % 10 AS digit
        FROM fx_orders o LEFT JOIN (SELECT vbeln, count(DISTINCT delivery) AS nd, min(delivery) AS first FROM fx_deliveries GROUP BY 1) a ON o.vbeln = a.vbeln LEFT JOIN fx_deliveries d ON d.delivery = a.first
        LEFT JOIN (SELECT vbeln, count(DISTINCT invoice) AS ni FROM fx_invoices JOIN fx_deliveries USING (delivery) GROUP BY 1) i ON o.vbeln = i.vbeln""",
    "dc_days": """SELECT *, CASE WHEN billed THEN greatest(1, base - 4) WHEN delivered THEN greatest(2, base - 2) WHEN flow = 0 THEN base + 3 ELSE base END + 2 AS days FROM (SELECT *, 7 + CASE WHEN v > 100000 THEN 5 WHEN v > 50000 THEN 3 ELSE 0 END AS base FROM dc_flow)""",
    "dc_scores": f"SELECT *, {_SUM(0.3, _LATE)} AS late, {_WHY(_LATE)} AS late_why, {_SUM(0.15, _CREDIT)} AS credit, {_WHY(_CREDIT)} AS credit_why FROM dc_days",
    "dc_risk": f"""SELECT vbeln AS doc_number, 'late_delivery' AS prediction_type, late AS probability, CAST(late >= 0.5 AS DOUBLE) AS predicted_value, {_LEVEL4.format(p='late')} AS risk_level, late_why AS factors FROM dc_scores
        UNION ALL SELECT vbeln, 'credit_hold', credit, CAST(credit >= 0.5 AS DOUBLE), {_LEVEL4.format(p='credit')}, credit_why FROM dc_scores
        UNION ALL SELECT vbeln, 'completion_time', round(greatest(0.5, least(0.95, 0.84 - CASE WHEN days > 14 THEN 0.1 ELSE 0 END - CASE WHEN flow = 0 THEN 0.05 ELSE 0 END)), 4), CAST(days AS DOUBLE),
        CASE WHEN days > 21 THEN 'critical' WHEN days > 14 THEN 'high' WHEN days > 7 THEN 'medium' ELSE 'low' END,
        concat_ws(',', CASE WHEN v > 50000 THEN 'order_complexity' END, CASE WHEN billed OR delivered OR flow = 0 THEN 'process_progress' END, 'seasonal_factor') FROM dc_scores""",
    "dc_levels": """SELECT p.*, remaining_hours, CASE WHEN p.probability >= 0.8 THEN 'critical' WHEN p.probability >= 0.6 THEN 'high' WHEN p.probability >= 0.4 THEN 'medium' WHEN p.probability >= 0.2 THEN 'low' ELSE 'minimal' END AS risk_level
        FROM ft_pred p JOIN ft_hours h ON p.case_id = h.case_id""",
    "dc_alerts": """SELECT doc_number, prediction_type AS alert_type, risk_level AS severity, probability, CASE prediction_type WHEN 'late_delivery' THEN 'High risk of late delivery (' || CAST(CAST(round(probability * 100) AS INT) AS VARCHAR) || '% probability)'
        WHEN 'credit_hold' THEN 'Order likely to be placed on credit hold (' || CAST(CAST(round(probability * 100) AS INT) AS VARCHAR) || '% probability)' ELSE 'Extended completion time expected: ' || CAST(CAST(predicted_value AS INT) AS VARCHAR) || ' days' END AS message,
        """ + "CASE prediction_type " + " ".join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in D.ACTIONS.items()) + " END AS recommended_actions FROM dc_risk WHERE probability >= 0.7",
    "dc_first": "SELECT case_id, " + ", ".join(f"min(struct_pack(t := ts, e := event_id)) FILTER (activity = '{a}') AS f{i}, count(*) FILTER (activity = '{a}') AS n{i}" for i, a in enumerate(sorted({x for _, acts, _ in D.PURCHASE_PATTERNS for x in acts} | {D.REQUISITION}))) + " FROM fx_purchase_log GROUP BY 1",
    "dc_hits": "SELECT p.*, alert_type, severity, ts FROM (SELECT e.case_id, 'late_delivery' AS prediction_type, value / 50 AS probability, ts FROM fx_event_log e) p JOIN (VALUES ('late_delivery_risk', 0.7, 'high'), ('late_delivery_risk', 0.9, 'critical')) t(alert_type, threshold, severity) ON probability >= threshold",
}
_AT = {a: i for i, a in enumerate(sorted({x for _, acts, _ in D.PURCHASE_PATTERNS for x in acts} | {D.REQUISITION}))}


def _pattern(name: str, acts: list[str]) -> str:
    f = [f"f{_AT[a]}" for a in acts]
    if name.startswith("3-Way"):
        return " AND ".join(f"{x} IS NOT NULL" for x in f)
    if name.startswith("Late"):
        return f"{f[1]} > {f[0]}"
    if name.startswith("Maverick"):
        return f"{f[0]} IS NOT NULL AND f{_AT[D.REQUISITION]} IS NULL"
    if name.startswith("Excessive"):
        return " + ".join(f"n{_AT[a]}" for a in acts) + " >= 2"
    return " OR ".join(f"{x} IS NOT NULL" for x in f)


def _reach(t):
    return C.doc_flow(t.doc_flow(), t.orders().select("vbeln"))


def _risk(t):
    return D.document_risk(t.orders(), _reach(t), t.deliveries(), RISK_AS_OF, ["0012", "0013"], ["SO"])


def _levels(t):
    f = R.case_features_ext(t.o2c_log(), AS_OF)
    return R.predictions(f).withColumn("risk_level", R.risk_level(F.col("probability"))).join(R.score_completion_time(f).select("case_id", "remaining_hours"), "case_id")


def _hits(t):
    return R.threshold_hits(t.event_log().select("case_id", "ts", (F.col("value") / 50).alias("probability"), F.lit("late_delivery").alias("prediction_type")))


_PERCENT = "CAST(CAST(round(probability * 100) AS INT) AS VARCHAR)"
_DAYS = "CAST(CAST(round(remaining_hours / 24) AS INT) AS VARCHAR)"
_CARDS = "SELECT industry, vkorg, CASE WHEN netwr > 200000 THEN 'HIGH' ELSE 'LOW' END AS category FROM fx_orders"
QUERIES = {
    "doc_text": (lambda t: D.doc_text(t.texts(), t.orders().where("vkorg < '0012'")), "SELECT doc_key, CASE level WHEN 'item' THEN 'item' ELSE 'header' END AS level, posnr, lang, text, changed AS changed_at FROM fx_texts WHERE level IN ('header', 'item') AND vkorg < '0012'"),
    "consolidate_texts": (lambda t: D.consolidate_texts(t.orders().select(F.col("vbeln").alias("doc_key")), t.texts()), f"""SELECT vbeln AS doc_key, coalesce(c, '') AS consolidated_text FROM fx_orders LEFT JOIN (SELECT doc_key, string_agg(trim(text, ' '), ' ' ORDER BY {_PLACE}, coalesce(posnr, ''), lang, trim(text, ' ')) AS c
        FROM fx_texts WHERE trim(text, ' ') <> '' GROUP BY 1) ON vbeln = doc_key"""),
    "search_texts": (lambda t: D.search_texts(t.texts(), "license|tion", "order", "1993-01-01", "1998-06-30", [f"{i:04d}" for i in range(15)]), _SEARCH.format(key="doc_key", table="fx_texts", pattern="license|tion", where="AND level = 'header' AND changed BETWEEN DATE '1993-01-01' AND DATE '1998-06-30' AND vkorg < '0015'")),
    "label_documents": (lambda t: D.label_documents(t.orders().select(F.col("vbeln").alias("doc_key"), "netwr"), t.orders().where("orderkey % 4 <> 0").select(F.col("vbeln").alias("doc_key"), (F.col("orderkey") % 5).alias("cluster"))), "SELECT vbeln AS doc_key, netwr, CASE WHEN orderkey % 4 <> 0 THEN orderkey % 5 END AS cluster FROM fx_orders"),
    "document_risk": (_risk, "SELECT * FROM dc_risk"),
    "document_alerts": (lambda t: D.document_alerts(_risk(t)), "SELECT * FROM dc_alerts"),
    "top_alerts": (lambda t: D.sort_alerts(D.document_alerts(_risk(t)), "high", 20), f"SELECT * FROM dc_alerts WHERE {_RANK} <= 2 ORDER BY {_RANK}, probability DESC, doc_number, alert_type LIMIT 20"),
    "risk_alerts": (lambda t: D.risk_alerts(_levels(t)), f"""SELECT case_id, CASE risk_level WHEN 'critical' THEN 'immediate_action' ELSE 'risk_warning' END AS alert_type, prediction_type, risk_level, probability,
        CASE WHEN risk_level = 'critical' THEN 'CRITICAL: Case ' || case_id || CASE prediction_type WHEN 'late_delivery' THEN ' has ' || {_PERCENT} || '% probability of late delivery. Immediate action required.'
            WHEN 'credit_hold' THEN ' has ' || {_PERCENT} || '% probability of credit hold. Review immediately.' ELSE ' estimated to take ' || {_DAYS} || ' more days. Exceeds SLA threshold.' END
        ELSE 'Case ' || case_id || CASE prediction_type WHEN 'late_delivery' THEN ' has ' || {_PERCENT} || '% probability of late delivery.' WHEN 'credit_hold' THEN ' has ' || {_PERCENT} || '% probability of being put on credit hold.'
            ELSE ' estimated to complete in ' || {_DAYS} || ' days.' END END AS message FROM dc_levels WHERE risk_level IN ('critical', 'high')"""),
    "high_risk_cases": (lambda t: D.high_risk_cases(R.predictions(R.case_features_ext(t.o2c_log(), AS_OF))), "SELECT case_id, w.t AS prediction_type, w.p AS probability FROM (SELECT case_id, max(struct_pack(p := probability, t := prediction_type)) AS w FROM ft_pred GROUP BY 1) WHERE w.p >= 0.6"),
    "alerts_by_severity": (lambda t: D.sort_alerts(_hits(t).select("case_id", "alert_type", "severity", "probability", "ts"), "high", 100), f"SELECT case_id, alert_type, severity, probability, ts FROM dc_hits ORDER BY {_RANK}, probability DESC, ts DESC, case_id, alert_type LIMIT 100"),
    "handoffs": (lambda t: D.handoffs(t.event_log()), "SELECT case_id, count(DISTINCT resource) AS n_resources, count(*) FILTER (resource <> before) AS resource_changes FROM (SELECT *, lag(resource) OVER (PARTITION BY case_id ORDER BY ts, event_id, activity) AS before FROM fx_event_log) GROUP BY 1"),
    "recent_activities": (lambda t: D.recent_activities(t.event_log()), "SELECT case_id, max(activity) FILTER (n = 1) AS current_activity, max(activity) FILTER (n = 2) AS previous_activity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC, activity DESC) AS n FROM fx_event_log) GROUP BY 1"),
    "filter_values": (lambda t: D.filter_values(t.orders().select("industry", "vkorg", F.when(F.col("netwr") > 200000, "HIGH").otherwise("LOW").alias("category")), ["industry", "vkorg", "category"]), f"SELECT 'industry' AS facet, industry AS value, count(*) AS n FROM ({_CARDS}) GROUP BY 2 UNION ALL SELECT 'vkorg', vkorg, count(*) FROM ({_CARDS}) GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM ({_CARDS}) GROUP BY 2"),
    "process_context": (lambda t: D.process_context(t.purchase_log()), "SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_purchase_log"),
    "process_patterns": (lambda t: D.process_patterns(t.purchase_log()), " UNION ALL ".join(f"SELECT '{name}' AS name, '{sure}' AS confidence, count(*) FILTER ({_pattern(name, acts)}) AS n_cases FROM dc_first" for name, acts, sure in D.PURCHASE_PATTERNS)),
    "search_doc_text": (lambda t: C.search_doc_text(t.read("documents"), "license|tion the", "doc_id"), _SEARCH.format(key="doc_id", table="documents", pattern="license|tion the", where="")),
}
