"""Queries on whole documents, their reasons and their evidence, on search through trigrams, and on styled maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import details as D
from ..operators import log as L
from ..operators import search as S
from ..sources import readers
from .document_queries import _SEARCH
from .feature_queries import _typed

#: Names of activities in other words, and the milestones that they are.
NAMES = {
    "Create Sales Order": "order_created", "SO Created": "order_created", "outboundDelivery": "delivery_created", "PGI": "goods_issued", "Post Goods Issue": "goods_issued", "billing-document": "invoice_created", "CheckCredit": "credit_check",
    "credit block": "credit_hold", "Create PO": "purchase_order", "GR posted": "goods_receipt", "Record Service Entry Sheet": "service_entry", "IR Posted": "invoice_receipt", "Approve Budget": "", "OrderCreated": "order_created",
}
_TYPE = "CASE prediction_type WHEN 'completion_time' THEN 'raw' WHEN 'credit_hold' THEN 'heuristic' ELSE 'probability' END"
_PLACE = "row_number() OVER (PARTITION BY BUKRS, BELNR, GJAHR ORDER BY BUZEI, HKONT, SHKZG, WRBTR)"
_TEXT = "coalesce(s.TXT50, a.TXT50)"
PATTERN = "license|tion the"


def _named(t):
    names = F.array(*map(F.lit, NAMES))
    return t.event_log().select("event_id", "case_id", names[(F.col("event_id") % len(NAMES)).cast("int")].alias("activity"))


def _order_line(t):
    lines = D.whole_orders(t.orders(), t.deliveries(), t.invoices(), t.doc_flow())
    sent = F.array_join(F.transform("deliveries", lambda d: F.concat_ws(":", d["delivery"], d["created"].cast("string"), F.coalesce(d["actual_gi"].cast("string"), F.lit("-")))), ",")
    billed = F.array_join(F.transform("invoices", lambda i: F.concat_ws(":", i["invoice"], i["billing_date"].cast("string"))), ",")
    return lines.select("doc_key", sent.alias("deliveries"), billed.alias("invoices"), F.col("customer.customer_id").alias("customer_id"), "customer_industry", F.col("dates.delivery_date").alias("delivery_date"), F.col("timing.order_to_invoice_days").alias("order_to_invoice_days"), F.col("n_deliveries").cast("long").alias("n_deliveries"), F.col("n_invoices").cast("long").alias("n_invoices"))


def _purchases(t):
    log = t.purchase_log().withColumn("item", (F.col("event_id") % 3 * 10).cast("string"))
    return D.purchase_documents(log)


def _evidence(t):
    docs = t.orders().select(F.concat("auart", F.lit("-"), "vkorg").alias("cluster"), F.when(F.col("orderkey") % 3 == 0, 5).alias("order_to_delivery_days"), F.when(F.col("orderkey") % 4 != 0, F.col("industry")).otherwise(" ").alias("consolidated_text"))
    return D.evidence(docs, ["order_to_delivery_days", "consolidated_text"])


def _export(t):
    heads = t.orders().select(F.col("vbeln").alias("SALESDOCUMENT"), F.col("auart").alias("SalesDocumentType"), F.col("kunnr").alias("SOLDTOPARTY"), F.lit(1).alias("NOTOURS"))
    items = t.items().select(F.col("vbeln").alias("SALESDOCUMENT"), F.col("posnr").alias("SALESDOCUMENTITEM"), F.col("netwr").alias("NETAMOUNT"))
    customers = t.read("customer").select(F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("CUSTOMER"), F.col("c_nationkey").cast("string").alias("COUNTRY"))
    made = readers.sales_documents(heads, items, customers)
    return made.select("document_number", "order_type", "customer", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.get("items", F.lit(0))["item_number"], F.lit("")).alias("first_item"), F.col("customer_master.country").alias("country"))


def _maps(t):
    return D.styled_map_lines(D.filter_edges(L.bottlenecks(t.event_log()), 3), title="Events")


def _HOLDS(word):  # noqa: N802
    """DuckDB text: whether a text holds all trigrams of a word."""
    return "(" + " AND ".join(f"contains(lower(text), '{word[i:i + 3]}')" for i in range(len(word) - 2)) + ")"


_EDGE = "from_activity, to_activity, n, mean_hours, level"
_TIME = "CASE WHEN h < 1 THEN CAST(CAST(round(h * 60) AS INT) AS VARCHAR) || 'm' WHEN h < 24 THEN CAST(round(h, 1) AS VARCHAR) || 'h' WHEN h / 24 < 7 THEN CAST(round(h / 24, 1) AS VARCHAR) || 'd' ELSE CAST(round(h / 24 / 7, 1) AS VARCHAR) || 'w' END"
VIEWS = {
    "dt_lines": f"""SELECT BUKRS, BELNR, GJAHR, {_PLACE} AS position, BUZEI, b.HKONT, {_TEXT} AS account_description, CASE WHEN SHKZG = 'S' THEN abs(WRBTR) END AS debit_amount, CASE WHEN SHKZG <> 'S' THEN abs(WRBTR) END AS credit_amount
        FROM fx_bseg b LEFT JOIN fx_ska1 a ON b.HKONT = a.SAKNR LEFT JOIN fx_skat s ON b.HKONT = s.SAKNR""",
    "dt_edges": f"SELECT {_EDGE}, row_number() OVER (ORDER BY from_activity, to_activity) - 1 AS i FROM lg_levels WHERE n >= 3",
    "dt_buys": """SELECT case_id, min(ts) FILTER (activity LIKE '%Create%' OR activity LIKE '%Record Purchase Order%') AS created_ts, min(ts) FILTER (activity LIKE '%Goods Receipt%' OR activity LIKE '%Receive Goods%') AS receipt_ts,
        min(ts) FILTER (activity LIKE '%Invoice%') AS invoice_ts, arg_min(vendor, (ts, event_id)) AS customer, list_sort(list(DISTINCT CAST(event_id % 3 * 10 AS VARCHAR))) AS items FROM fx_purchase_log GROUP BY 1""",
    "dt_evidence": "SELECT auart || '-' || vkorg AS cluster, count(*) AS n, count(*) FILTER (orderkey % 3 = 0) AS timed, count(*) FILTER (orderkey % 4 <> 0) AS texts FROM fx_orders GROUP BY 1",
}
QUERIES = {
    "fi_document_lines": (lambda t: D.ledger_lines(t.bkpf(), t.bseg(), t.ska1(), t.skat()), "SELECT BUKRS, BELNR, GJAHR, CAST(position AS INT) AS position, BUZEI, HKONT, account_description, debit_amount, credit_amount FROM dt_lines"),
    "fi_document_whole": (lambda t: D.ledger_documents(t.bkpf(), t.bseg(), t.ska1(), t.skat()).select("BUKRS", "BELNR", "GJAHR", "total_debit", "total_credit", "is_balanced", F.array_join(F.col("line_items.BUZEI"), ",").alias("places"), F.array_join(F.transform("line_items", lambda x: F.coalesce(x["account_description"], F.lit("?"))), ",").alias("texts")),
        """SELECT BUKRS, BELNR, GJAHR, coalesce(d, 0) AS total_debit, coalesce(c, 0) AS total_credit, abs(coalesce(d, 0) - coalesce(c, 0)) < 0.01 AS is_balanced, coalesce(places, '') AS places, coalesce(texts, '') AS texts FROM fx_bkpf LEFT JOIN
        (SELECT BUKRS, BELNR, GJAHR, sum(debit_amount) AS d, sum(credit_amount) AS c, string_agg(BUZEI, ',' ORDER BY position) AS places, string_agg(coalesce(account_description, '?'), ',' ORDER BY position) AS texts FROM dt_lines GROUP BY ALL) USING (BUKRS, BELNR, GJAHR)"""),
    "whole_orders": (_order_line, """SELECT doc_key, coalesce(d, '') AS deliveries, coalesce(i, '') AS invoices, o.kunnr AS customer_id, o.industry AS customer_industry, delivery_date, order_to_invoice_days, u.n_deliveries, u.n_invoices FROM ch_unified u JOIN fx_orders o ON doc_key = o.vbeln
        LEFT JOIN (SELECT ch_od.vbeln, string_agg(delivery || ':' || created || ':' || coalesce(CAST(actual_gi AS VARCHAR), '-'), ',' ORDER BY delivery) AS d FROM ch_od JOIN fx_deliveries USING (delivery) GROUP BY 1) x ON x.vbeln = doc_key
        LEFT JOIN (SELECT vbeln, string_agg(invoice || ':' || billing_date, ',' ORDER BY invoice) AS i FROM (SELECT DISTINCT ch_od.vbeln, ch_di.invoice FROM ch_di JOIN ch_od USING (delivery)) JOIN (SELECT DISTINCT invoice, billing_date FROM fx_invoices) USING (invoice) GROUP BY 1) y ON y.vbeln = doc_key"""),
    "purchase_documents": (lambda t: _purchases(t).withColumn("items", F.array_join(F.col("items.item_number"), ",")), """SELECT case_id AS document_number, created_ts, 'NB' AS order_type, customer, '' AS sales_org, array_to_string(items, ',') AS items, CASE WHEN receipt_ts IS NOT NULL THEN 'GR' || case_id END AS receipt_number,
        receipt_ts, CASE WHEN invoice_ts IS NOT NULL THEN 'IR' || case_id END AS invoice_number, invoice_ts FROM dt_buys"""),
    "purchase_flow": (lambda t: D.purchase_flow(_purchases(t)), """SELECT case_id AS preceding_doc, 'GR' || case_id AS subsequent_doc, 'F' AS preceding_category, 'R' AS subsequent_category FROM dt_buys WHERE receipt_ts IS NOT NULL
        UNION ALL SELECT CASE WHEN receipt_ts IS NOT NULL THEN 'GR' || case_id ELSE case_id END, 'IR' || case_id, CASE WHEN receipt_ts IS NOT NULL THEN 'R' ELSE 'F' END, 'P' FROM dt_buys WHERE invoice_ts IS NOT NULL"""),
    "milestone_names": (lambda t: D.with_milestones(_named(t), list(D.VARIATIONS)).select("event_id", F.coalesce("milestone", F.lit("")).alias("milestone")), "SELECT event_id, [" + ", ".join(f"'{m}'" for m in NAMES.values()) + f"][CAST(event_id % {len(NAMES)} AS INT) + 1] AS milestone FROM fx_event_log"),
    "risk_breakdown": (lambda t: D.risk_breakdown(_typed(t), 336.0), f"""SELECT case_id, prediction_type, value_type, value, value_type <> 'heuristic' AS is_included, CASE value_type WHEN 'probability' THEN 'True probability from classifier' WHEN 'raw' THEN 'Converted to SLA ratio (SLA=336.0h)'
        ELSE 'Excluded: heuristic scores not mixed with probabilities' END AS reason, CASE value_type WHEN 'raw' THEN round(least(1.0, value / 336.0), 6) WHEN 'probability' THEN round(value, 6) END AS risk_contribution
        FROM (SELECT case_id, prediction_type, {_TYPE} AS value_type, CASE WHEN {_TYPE} = 'raw' THEN probability * 336 ELSE probability END AS value FROM ft_pred)"""),
    "strip_document": (lambda t: D.strip_document(t.orders(), "sales_header"), "SELECT vbeln, vkorg, kunnr, auart, erdat, vdatu, netwr FROM fx_orders"),
    "purchase_stats": (lambda t: D.purchase_stats(t.purchase_log()), "SELECT count(*) AS n_events, count(DISTINCT case_id) AS n_cases, count(DISTINCT case_id) AS n_documents, count(DISTINCT vendor) AS n_vendors, count(DISTINCT activity) AS n_activities, count(DISTINCT resource) AS n_resources, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_purchase_log"),
    "evidence_fields": (lambda t: _evidence(t).select("cluster", "n", F.explode("fields").alias("f")).select("cluster", "n", "f.*"), "SELECT cluster, n, 'order_to_delivery_days' AS field, timed AS n_present, round(timed / n, 4) AS coverage FROM dt_evidence UNION ALL SELECT cluster, n, 'consolidated_text', texts, round(texts / n, 4) FROM dt_evidence"),
    "evidence_warnings": (lambda t: D.evidence_warnings(_evidence(t)), """SELECT cluster, 'small_sample' AS kind, CASE WHEN n < 10 THEN 'warning' ELSE 'info' END AS level, CASE WHEN n < 10 THEN 'Small sample size (' || n || ' documents). Results may not be reliable.' ELSE 'Moderate sample size (' || n || ' documents). Interpret with caution.' END AS message, NULL AS field FROM dt_evidence WHERE n < 30
        UNION ALL SELECT cluster, 'missing_data', 'warning', 'Only ' || timed || '/' || n || ' documents have complete timing data.', 'order_to_delivery_days' FROM dt_evidence WHERE timed < n * 0.5
        UNION ALL SELECT cluster, 'missing_data', 'warning', 'Only ' || texts || '/' || n || ' documents have text content.', 'consolidated_text' FROM dt_evidence WHERE texts < n * 0.8"""),
    "csv_profile": (lambda t: readers.csv_profile(t.orders().select(F.col("vbeln").alias("VBELN"), F.col("erdat").alias("ERDAT"), F.lit(1).alias("OTHER")), {"order_number": ["VBELN", "Order"], "order_date": ["ERDAT"], "customer": ["KUNNR", "Customer"]}, ["order_number", "customer"]),
        "SELECT *, (SELECT count(*) FROM fx_orders) AS n_rows FROM (VALUES ('VBELN', TRUE, 'order_number', 'mapped', NULL), ('ERDAT', TRUE, 'order_date', 'mapped', NULL), ('OTHER', FALSE, NULL, 'unmapped', NULL), ('customer', FALSE, NULL, 'missing', 'KUNNR,Customer')) v(\"column\", is_mapped, maps_to, status, expected)"),
    "sales_documents": (_export, """SELECT o.vbeln AS document_number, auart AS order_type, kunnr AS customer, coalesce(n, 0) AS n_items, coalesce(f, '') AS first_item, CAST(c_nationkey AS VARCHAR) AS country FROM fx_orders o LEFT JOIN (SELECT vbeln, count(*) AS n, min(posnr) AS f FROM fx_items GROUP BY 1) i ON o.vbeln = i.vbeln
        LEFT JOIN customer ON lpad(CAST(c_custkey AS VARCHAR), 10, '0') = kunnr"""),
    "styled_map": (_maps, f"""SELECT CAST(row_number() OVER (ORDER BY b, i) - 1 AS INT) AS position, line FROM (SELECT 0 AS b, i, l AS line FROM (VALUES (0, '---'), (1, 'title: Events'), (2, '---'), (3, 'flowchart LR')) h(i, l)
        UNION ALL SELECT 1, row_number() OVER (ORDER BY a), '    ' || a || '([' || a || '])' FROM (SELECT from_activity AS a FROM dt_edges UNION SELECT to_activity FROM dt_edges)
        UNION ALL SELECT 2, i, '    ' || from_activity || ' --> |' || {_TIME} || CASE WHEN n > 1 THEN ', n=' || n ELSE '' END || '| ' || to_activity FROM (SELECT *, mean_hours AS h FROM dt_edges)
        UNION ALL SELECT 3, i, '    linkStyle ' || i || ' ' || CASE level WHEN 'fast' THEN 'stroke:#22c55e,stroke-width:2px' WHEN 'medium' THEN 'stroke:#eab308,stroke-width:3px' ELSE 'stroke:#ef4444,stroke-width:4px' END FROM dt_edges)"""),
    "search_indexed": (lambda t: S.search_indexed(t.read("documents"), S.trigrams(t.read("documents"), "doc_id"), PATTERN, "doc_id"), _SEARCH.format(key="doc_id", table="documents", pattern=PATTERN, where="")),
    "search_cost": (lambda t: S.search_cost(t.read("documents"), S.trigrams(t.read("documents"), "doc_id"), PATTERN, "doc_id", most=99), f"""SELECT count(*) AS n_texts, count(*) FILTER ({_HOLDS('license')} OR {_HOLDS('tion the')}) AS n_candidates, count(*) FILTER (regexp_matches(text, '(?i){PATTERN}')) AS n_matches
        FROM documents"""),
}
