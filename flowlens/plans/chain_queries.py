"""Queries over the document chain."""

from __future__ import annotations

from ..operators import chain as C

VIEWS = {
    "ch_od": "SELECT vbeln, delivery FROM fx_deliveries UNION SELECT vbelv, vbeln FROM fx_doc_flow WHERE vbtyp_v = 'C' AND vbtyp_n = 'J'",
    "ch_di": "SELECT delivery, invoice FROM fx_invoices UNION SELECT vbelv, vbeln FROM fx_doc_flow WHERE vbtyp_v = 'J' AND vbtyp_n = 'M'",
    "ch_unified": """SELECT o.vbeln AS doc_key, vkorg, industry, erdat, vdatu, delivery_date, invoice_date, coalesce(n_deliveries, 0) AS n_deliveries, coalesce(n_invoices, 0) AS n_invoices,
        CAST(delivery_date - erdat AS INT) AS order_to_delivery_days, CAST(delivery_date - vdatu AS INT) AS delivery_delay_days, CAST(invoice_date - delivery_date AS INT) AS invoice_lag_days, CAST(invoice_date - erdat AS INT) AS order_to_invoice_days
        FROM fx_orders o LEFT JOIN (SELECT ch_od.vbeln, count(DISTINCT delivery) AS n_deliveries, min(coalesce(actual_gi, created)) AS delivery_date FROM ch_od JOIN fx_deliveries USING (delivery) GROUP BY 1) d ON o.vbeln = d.vbeln
        LEFT JOIN (SELECT vbeln, count(DISTINCT invoice) AS n_invoices, min(billing_date) AS invoice_date FROM (SELECT DISTINCT ch_od.vbeln, ch_di.invoice FROM ch_di JOIN ch_od USING (delivery)) JOIN fx_invoices USING (invoice) GROUP BY 1) i ON o.vbeln = i.vbeln""",
}
_LABEL = "CASE vbtyp_n WHEN 'J' THEN 'Delivery' WHEN 'M' THEN 'Invoice' ELSE vbtyp_n END"
QUERIES = {
    "order_deliveries": (lambda t: C.order_deliveries(t.deliveries(), t.doc_flow()), "SELECT * FROM ch_od"),
    "delivery_invoices": (lambda t: C.delivery_invoices(t.invoices(), t.doc_flow()), "SELECT * FROM ch_di"),
    "unified_documents": (lambda t: C.unified_documents(t.orders(), t.deliveries(), t.invoices(), t.doc_flow()), "SELECT * FROM ch_unified"),
    "doc_flow": (lambda t: C.doc_flow(t.doc_flow(), t.orders().select("vbeln")), """WITH RECURSIVE r(root, document, category, depth) AS (SELECT vbeln, vbeln, 'C', 0 FROM fx_orders UNION SELECT r.root, f.vbeln, f.vbtyp_n, r.depth + 1 FROM r JOIN fx_doc_flow f ON f.vbelv = r.document WHERE r.depth < 50)
        SELECT root, document, arg_min(category, depth) AS category, min(depth) AS depth FROM r GROUP BY root, document"""),
    "log_doc_flow": (lambda t: C.log_doc_flow(t.o2c_log()), """SELECT case_id AS document, activity, CASE WHEN lower(activity) LIKE '%invoice%' THEN 'M' WHEN lower(activity) LIKE '%goods%' THEN 'R' WHEN lower(activity) LIKE '%delivery%' THEN 'J'
        WHEN lower(activity) LIKE '%order%' THEN 'C' ELSE 'X' END AS category, ts, CAST(row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id, activity) AS INT) AS position FROM fx_o2c_log"""),
    "delivery_timing": (lambda t: C.delivery_timing(t.deliveries(), t.orders()), "SELECT delivery, d.vbeln, vdatu AS requested_date, created AS planned_gi, actual_gi, CAST(actual_gi - vdatu AS INT) AS delay_days FROM fx_deliveries d LEFT JOIN fx_orders o ON d.vbeln = o.vbeln"),
    "invoice_timing": (lambda t: C.invoice_timing(t.invoices(), t.deliveries()), "SELECT invoice, billing_date, string_agg(DISTINCT delivery, ',') AS deliveries, string_agg(DISTINCT vbeln, ',') AS orders FROM fx_invoices JOIN fx_deliveries USING (delivery) GROUP BY invoice, billing_date"),
    "documents_by_org": (lambda t: C.documents_by_org(t.orders(), "0007"), "SELECT * FROM fx_orders WHERE vkorg = '0007'"),
    "sales_orgs": (lambda t: C.sales_orgs(t.orders()), "SELECT DISTINCT vkorg FROM fx_orders"),
    "sales_header": (lambda t: C.sales_header(t.orders(), t.deliveries().where("status = 'O'")), "SELECT * FROM fx_orders WHERE vbeln IN (SELECT vbeln FROM fx_deliveries WHERE status = 'O')"),
    "sales_items": (lambda t: C.sales_items(t.items(), t.orders().where("industry = 'BUILDING'")), "SELECT * FROM fx_items WHERE vbeln IN (SELECT vbeln FROM fx_orders WHERE industry = 'BUILDING')"),
    "master_stub": (lambda t: C.master_stub(t.read("customer"), "c_custkey", ["c_nationkey", "c_mktsegment"]), "SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) AS id, c_nationkey, c_mktsegment FROM customer"),
    "strip_fields": (lambda t: C.strip_fields(t.orders(), {"vbeln", "auart", "erdat", "kunnr"}, {"kunnr"}), "SELECT vbeln, auart, erdat FROM fx_orders"),
    "limit_rows": (lambda t: C.limit_rows(t.orders().select("vbeln", "netwr"), ["vbeln"]), "SELECT vbeln, netwr, (SELECT count(*) > 200 FROM fx_orders) AS truncated FROM fx_orders ORDER BY vbeln LIMIT 200"),
    "search_attributes": (lambda t: C.search_attributes(t.orders(), "building|SO", "1998-01-01", "1998-12-31"), """SELECT vbeln, concat_ws(' ', auart, vkorg, kunnr, industry) AS attributes FROM fx_orders
        WHERE regexp_matches(concat_ws(' ', auart, vkorg, kunnr, industry), '(?i)building|SO') AND vdatu >= DATE '1998-01-01' AND erdat <= DATE '1998-12-31'"""),
    "orders_from_event_log": (lambda t: C.orders_from_event_log(t.event_log(), ["signup"], ["view"], ["purchase"]), """SELECT case_id AS document, min(ts) FILTER (activity = 'signup') AS created_ts, min(ts) FILTER (activity = 'view') AS receipt_ts,
        min(ts) FILTER (activity = 'purchase') AS invoice_ts, count(DISTINCT resource) AS n_resources FROM fx_event_log GROUP BY 1"""),
    "map_activities": (lambda t: C.map_activities(t.event_log(), {"signup": "Create", "purchase": "Invoice"}).groupBy("activity").count().withColumnRenamed("count", "n"), "SELECT CASE activity WHEN 'signup' THEN 'Create' WHEN 'purchase' THEN 'Invoice' ELSE activity END AS activity, count(*) AS n FROM fx_event_log GROUP BY 1"),
    "flow_entries_to_documents": (lambda t: C.flow_entries_to_documents(t.doc_flow()), f"SELECT vbeln AS document, {_LABEL} AS category, string_agg(DISTINCT vbelv, ',' ORDER BY vbelv) AS predecessors, min(erdat) AS created FROM fx_doc_flow GROUP BY 1, 2"),
}
