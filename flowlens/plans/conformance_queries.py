"""Queries on conformance, over the log that mostly conforms and the one that mostly doesn't."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformance as C
from . import models as M

_LOG = "fx_o2c_clean_log"
_KNOWN = "activity IN ('OrderCreated', 'DeliveryCreated', 'GoodsIssued', 'InvoiceCreated')"
_ORDER = "CASE activity WHEN 'OrderCreated' THEN 0 WHEN 'DeliveryCreated' THEN 1 WHEN 'GoodsIssued' THEN 2 WHEN 'InvoiceCreated' THEN 3 END"
_NEED = "CASE activity WHEN 'DeliveryCreated' THEN 'OrderCreated' WHEN 'GoodsIssued' THEN 'DeliveryCreated' WHEN 'InvoiceCreated' THEN 'GoodsIssued' END"
_STEPS = "(VALUES ('OrderCreated', 1), ('DeliveryCreated', 2), ('GoodsIssued', 3), ('InvoiceCreated', 4)) m(activity, o)"


def _views(prefix: str, log: str) -> dict[str, str]:
    return {
        f"{prefix}_ev": f"SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id, activity) - 1 AS position, {_ORDER} AS o, {_NEED} AS need FROM {log}",
        f"{prefix}_seen": f"SELECT *, list(activity) OVER (PARTITION BY case_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, count(*) OVER (PARTITION BY case_id) AS n FROM {prefix}_ev",
        f"{prefix}_dev": f"""SELECT case_id, 'invalid_start' AS deviation_type, activity, position, '' AS detail FROM {prefix}_ev WHERE position = 0 AND o > 0
            UNION ALL SELECT case_id, 'skipped_activity', activity, position, need FROM {prefix}_seen WHERE need IS NOT NULL AND NOT coalesce(list_contains(seen, need), FALSE)
            UNION ALL SELECT DISTINCT a.case_id, 'wrong_order', a.activity, a.position, b.activity FROM {prefix}_ev a JOIN {prefix}_ev b ON a.case_id = b.case_id AND b.position < a.position AND b.o > a.o
            UNION ALL SELECT case_id, 'unexpected_activity', activity, position, '' FROM {prefix}_ev WHERE o IS NULL
            UNION ALL SELECT c.case_id, 'missing_activity', m.activity, -1, '' FROM (SELECT DISTINCT case_id FROM {prefix}_ev) c CROSS JOIN {_STEPS} WHERE NOT EXISTS (SELECT 1 FROM {prefix}_ev e WHERE e.case_id = c.case_id AND e.activity = m.activity)
            UNION ALL SELECT case_id, 'duplicate_activity', activity, position, CAST(f AS VARCHAR) FROM (SELECT *, min(position) OVER (PARTITION BY case_id, activity) AS f FROM {prefix}_ev WHERE o IS NOT NULL) WHERE position > f
            UNION ALL SELECT case_id, 'invalid_end', activity, position, '' FROM {prefix}_seen s WHERE position = n - 1 AND activity <> 'InvoiceCreated' AND 4 = (SELECT count(DISTINCT activity) FROM {prefix}_ev e WHERE e.case_id = s.case_id AND o IS NOT NULL)""",
        f"{prefix}_devs": f"""SELECT *, CASE WHEN deviation_type = 'invalid_start' OR (deviation_type IN ('skipped_activity', 'missing_activity') AND activity = 'OrderCreated') OR (deviation_type = 'wrong_order' AND activity = 'InvoiceCreated') THEN 'critical'
            WHEN deviation_type = 'missing_activity' AND activity = 'InvoiceCreated' THEN 'minor' WHEN deviation_type IN ('skipped_activity', 'wrong_order', 'missing_activity') THEN 'major' ELSE 'minor' END AS severity FROM {prefix}_dev""",
        f"{prefix}_cases": f"""SELECT case_id, coalesce(n, 0) AS n_deviations, round(greatest(0, 1 - coalesce(p, 0)), 4) AS fitness, n IS NULL AS is_conformant FROM (SELECT DISTINCT case_id FROM {prefix}_ev) LEFT JOIN
            (SELECT case_id, count(*) AS n, sum(CASE severity WHEN 'critical' THEN 0.30 WHEN 'major' THEN 0.15 ELSE 0.05 END) AS p FROM {prefix}_devs GROUP BY 1) USING (case_id)""",
        f"{prefix}_on": f"SELECT case_id, activity, position, o + 1 AS o FROM {prefix}_ev WHERE o IS NOT NULL",
        f"{prefix}_odev": f"""SELECT case_id, 'unexpected_activity' AS deviation_type, activity, 'major' AS severity FROM {prefix}_ev WHERE o IS NULL
            UNION ALL SELECT case_id, 'missing_activity', lower(regexp_replace(activity, '([a-z])([A-Z])', '\\1_\\2')), 'critical' FROM {prefix}_dev WHERE deviation_type = 'missing_activity'
            UNION ALL SELECT case_id, 'wrong_order', lower(regexp_replace(activity, '([a-z])([A-Z])', '\\1_\\2')), 'critical' FROM (SELECT *, max(o) OVER (PARTITION BY case_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {prefix}_on) WHERE o < high
            UNION ALL SELECT case_id, 'repeated_activity', lower(regexp_replace(activity, '([a-z])([A-Z])', '\\1_\\2')), 'minor' FROM {prefix}_on GROUP BY case_id, activity HAVING count(*) > 1""",
    }


VIEWS = _views("cf", "fx_o2c_clean_log") | _views("cx", "fx_o2c_log")


def _ordered(prefix: str) -> str:
    return f"""SELECT case_id, coalesce(n, 0) AS n_deviations, round(greatest(0, b - least(p, b)), 4) AS fitness FROM (SELECT case_id, n, coalesce(p, 0) AS p, 1 - coalesce(m, 0) / 4.0 AS b FROM (SELECT DISTINCT case_id FROM {prefix}_ev) LEFT JOIN
        (SELECT case_id, count(*) AS n, count(*) FILTER (deviation_type = 'missing_activity') AS m, sum(CASE severity WHEN 'critical' THEN 0.2 WHEN 'major' THEN 0.1 ELSE 0.05 END) AS p FROM {prefix}_odev GROUP BY 1) USING (case_id))"""


def _model(t, make):
    model = make()
    return model.frame(t.spark), model.name_frame(t.spark)


def _state(t, log):
    return C.check_conformance(log, *_model(t, M.o2c_simple))


def _found(t, log):
    return C.deviations(log, *_model(t, M.o2c_simple))


_SUMMARY = "SELECT count(*) AS n_cases, count(*) FILTER (is_conformant) AS n_conformant, round(avg(CAST(is_conformant AS INT)) * 100, 2) AS conformance_rate, round(avg(fitness), 4) AS avg_fitness, min(fitness) AS min_fitness, max(fitness) AS max_fitness, CAST(sum(n_deviations) AS BIGINT) AS n_deviations FROM"
#: Models of purchasing, ledger and cost accounting, each over a log whose events are dealt to its steps and to one that it lacks.
LINES = ["p2p_simple", "p2p_detailed", "fi_posting", "fi_period_close", "co_allocation"]
_RANKED = "CASE severity WHEN 'critical' THEN 0 WHEN 'major' THEN 1 WHEN 'minor' THEN 2 ELSE 3 END"


def _dealt(t, name):
    steps = [a for a, _, _ in M.MODELS[name]().steps] + ["something_else"]
    return t.event_log().withColumn("activity", F.array(*map(F.lit, steps))[(F.col("event_id") * 7 % len(steps)).cast("int")])


def _ordered_views(prefix: str, model: M.OrderedModel, log: str) -> dict[str, str]:
    steps = [a for a, _, _ in model.steps]
    place = "CASE activity " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(steps)) + " END"
    required = [a for a, needed, _ in model.steps if needed]
    return {
        f"{prefix}_log": log,
        f"{prefix}_known": f"SELECT *, {place} AS o, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id, activity) AS p FROM {prefix}_log WHERE {place} IS NOT NULL",
        f"{prefix}_dev": f"""SELECT case_id, 'unexpected_activity' AS deviation_type, activity, 'major' AS severity FROM {prefix}_log WHERE {place} IS NULL
            UNION ALL SELECT case_id, 'missing_activity', a, 'critical' FROM (SELECT case_id, a FROM (SELECT DISTINCT case_id FROM {prefix}_log) CROSS JOIN (SELECT unnest({required}) AS a) EXCEPT SELECT case_id, activity FROM {prefix}_known)
            UNION ALL SELECT case_id, 'wrong_order', activity, 'critical' FROM (SELECT *, max(o) OVER (PARTITION BY case_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM {prefix}_known) WHERE o < high
            UNION ALL SELECT case_id, 'repeated_activity', activity, 'minor' FROM {prefix}_known GROUP BY case_id, activity HAVING count(*) > 1""",
    }


def _fitness(prefix: str, required: int) -> str:
    return f"""SELECT case_id, coalesce(n, 0) AS n_deviations, round(greatest(0, b - least(p, b)), 4) AS fitness FROM (SELECT case_id, n, coalesce(p, 0) AS p, 1 - coalesce(m, 0) / {required}.0 AS b FROM (SELECT DISTINCT case_id FROM {prefix}_log) LEFT JOIN
        (SELECT case_id, count(*) AS n, count(*) FILTER (deviation_type = 'missing_activity') AS m, sum(CASE severity WHEN 'critical' THEN 0.2 WHEN 'major' THEN 0.1 ELSE 0.05 END) AS p FROM {prefix}_dev GROUP BY 1) USING (case_id))"""


for _name in LINES:
    _steps = [a for a, _, _ in M.MODELS[_name]().steps] + ["something_else"]
    VIEWS |= _ordered_views(f"md_{_name}", M.MODELS[_name](), f"SELECT case_id, event_id, ts, {_steps}[CAST(event_id * 7 % {len(_steps)} AS INT) + 1] AS activity FROM fx_event_log")
VIEWS |= _ordered_views("df", M.o2c_ordered(), """SELECT vbeln AS case_id, 'order_created' AS activity, erdat AS ts, 1 AS event_id FROM fx_orders UNION ALL SELECT vbeln, 'delivery_created', created, 2 FROM fx_deliveries
    UNION ALL SELECT vbeln, 'goods_issued', actual_gi, 3 FROM fx_deliveries WHERE actual_gi IS NOT NULL UNION ALL SELECT d.vbeln, 'invoice_created', billing_date, 4 FROM fx_invoices JOIN fx_deliveries d USING (delivery)""")
QUERIES = {
    "conformance_deviations": (lambda t: _found(t, t.o2c_clean_log()), "SELECT * FROM cf_devs"),
    "conformance_deviations_messy": (lambda t: _found(t, t.o2c_log()), "SELECT * FROM cx_devs"),
    "check_conformance": (lambda t: _state(t, t.o2c_clean_log()), "SELECT * FROM cf_cases"),
    "check_conformance_messy": (lambda t: _state(t, t.o2c_log()), "SELECT * FROM cx_cases"),
    "conformance_summary": (lambda t: C.conformance_summary(_state(t, t.o2c_clean_log())), f"{_SUMMARY} cf_cases"),
    "deviation_summary": (lambda t: C.deviation_summary(_found(t, t.o2c_clean_log())), "SELECT 'type' AS dimension, deviation_type AS value, count(*) AS n FROM cf_devs GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM cf_devs GROUP BY 2 UNION ALL SELECT 'activity', activity, count(*) FROM cf_devs GROUP BY 2"),
    "deviation_patterns": (lambda t: C.deviation_patterns(_found(t, t.o2c_clean_log())), "SELECT deviation_type, activity, count(*) AS n, count(DISTINCT case_id) AS n_cases FROM cf_devs GROUP BY 1, 2 ORDER BY n DESC, deviation_type, activity LIMIT 10"),
    "cases_by_fitness": (lambda t: C.cases_by_fitness(_state(t, t.o2c_clean_log()), 0.5, 0.9), "SELECT * FROM cf_cases WHERE fitness BETWEEN 0.5 AND 0.9"),
    "non_conformant": (lambda t: C.non_conformant(_state(t, t.o2c_clean_log())), "SELECT * FROM cf_cases WHERE NOT is_conformant"),
    "filter_deviations": (lambda t: C.filter_deviations(_found(t, t.o2c_clean_log()), ["critical"]), "SELECT * FROM cf_devs WHERE severity = 'critical'"),
    "missing_activities": (lambda t: C.missing_activities(C.traces(t.o2c_log(), *_model(t, M.o2c_simple)), _model(t, M.o2c_simple)[0]), "SELECT case_id, activity FROM cx_dev WHERE deviation_type = 'missing_activity'"),
    "order_violations": (lambda t: C.order_violations(t.o2c_log(), *_model(t, M.o2c_simple)), "SELECT case_id, activity, position, detail AS other FROM cx_dev WHERE deviation_type = 'wrong_order'"),
    "ordered_deviations": (lambda t: C.ordered_deviations(t.o2c_clean_log(), *_model(t, M.o2c_ordered)), "SELECT * FROM cf_odev"),
    "check_conformance_ordered": (lambda t: C.check_ordered(t.o2c_clean_log(), *_model(t, M.o2c_ordered)), _ordered("cf")),
    "check_conformance_ordered_messy": (lambda t: C.check_ordered(t.o2c_log(), *_model(t, M.o2c_ordered)), _ordered("cx")),
    "check_document_flow": (lambda t: C.check_document_flow(t.doc_flow(), t.orders(), t.deliveries(), *_model(t, M.o2c_ordered)), _fitness("df", 4)),
    "skipped_optional": (lambda t: C.skipped_optional(_dealt(t, "p2p_detailed"), *_model(t, M.MODELS["p2p_detailed"])), "SELECT case_id, activity FROM (SELECT DISTINCT case_id FROM md_p2p_detailed_log) CROSS JOIN (SELECT unnest(['pr_created', 'po_approved', 'invoice_cleared']) AS activity) EXCEPT SELECT case_id, activity FROM md_p2p_detailed_log"),
    "deviations_by_severity": (lambda t: C.deviations_by_severity(_found(t, t.o2c_log())), f"SELECT *, {_RANKED} AS rank FROM cx_devs"),
    **{f"conformance_{name}": (lambda t, name=name: C.ordered_deviations(_dealt(t, name), *_model(t, M.MODELS[name])), f"SELECT case_id, deviation_type, activity, severity FROM md_{name}_dev") for name in LINES},
    **{f"fitness_{name}": (lambda t, name=name: C.check_ordered(_dealt(t, name), *_model(t, M.MODELS[name])), _fitness(f"md_{name}", sum(r for _, r, _ in M.MODELS[name]().steps))) for name in LINES},
}
