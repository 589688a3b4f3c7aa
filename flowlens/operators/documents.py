"""Documents with their texts, the risk of single documents, and context for questions about a process.

Texts have doc_key, level (header, item or delivery), posnr, lang, text, changed, vkorg. Reach is the result of
chain.doc_flow: root, document, category, depth.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import search_doc_text

#: The fields of each kind of document that hold texts, and the names of the text in a text object.
TEXT_FIELDS = {
    "sales_orders": ["texts", "header_texts", "notes", "reason_for_rejection", "customer_po_text", "internal_notes", "shipping_instructions"],
    "deliveries": ["texts", "delivery_text", "shipping_notes", "picking_notes", "goods_issue_notes", "transport_notes"],
    "invoices": ["texts", "invoice_text", "billing_notes", "payment_terms_text"],
}
ITEM_FIELDS, CONTENT = ["texts", "item_text", "description"], ["text_content", "text", "content"]


def _texts(value: Column, kind: T.DataType) -> Column | None:
    """An array of the trimmed texts of a field: a text, a list of texts, or a list of text objects."""
    if isinstance(kind, T.StringType):
        return F.array(F.trim(value))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.transform(value, F.trim)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = [c for c in CONTENT if c in kind.elementType.names]
        if names:
            return F.transform(value, lambda x: F.trim(F.coalesce(*(F.when(x[c] != "", x[c]) for c in names))))
    return None


def extract_texts(df: DataFrame, kind: str = "sales_orders") -> Column:
    """All texts of nested documents: those of the known fields in their order, then those of the items."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    found = [_texts(F.col(name), fields[name]) for name in TEXT_FIELDS[kind] if name in fields]
    items = fields.get("items")
    if isinstance(items, T.ArrayType) and isinstance(items.elementType, T.StructType):
        inner = {f.name: f.dataType for f in items.elementType.fields}

        def of_item(x: Column) -> Column:
            parts = [_texts(x[name], inner[name]) for name in ITEM_FIELDS if name in inner]
            return F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts if p is not None)))

        if any(name in inner for name in ITEM_FIELDS):
            found.append(F.flatten(F.transform("items", of_item)))
    empty = F.array().cast("array<string>")
    every = F.flatten(F.array(*(F.coalesce(x, empty) for x in found if x is not None))) if any(x is not None for x in found) else empty
    return F.filter(every, lambda x: x.isNotNull() & (x != ""))


def consolidate_texts(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """documents (doc_key) with consolidated_text: all texts of the document, headers first, parted by spaces."""
    place = F.when(F.col("level") == "header", 0).when(F.col("level") == "item", 1).otherwise(2)
    one = F.struct(place.alias("place"), F.coalesce("posnr", F.lit("")).alias("posnr"), "lang", F.trim("text").alias("text"))
    joined = texts.where("trim(text) <> ''").groupBy("doc_key").agg(F.array_join(F.array_sort(F.collect_list(one))["text"], " ").alias("consolidated_text"))
    return documents.join(joined, "doc_key", "left").withColumn("consolidated_text", F.coalesce("consolidated_text", F.lit("")))


def doc_text(texts: DataFrame, keys: DataFrame, doc_type: str = "sales") -> DataFrame:
    """Header and item texts of a set of documents (vbeln); deliveries have header texts only, invoices none."""
    levels = {"sales": ["header", "item"], "delivery": ["delivery"]}.get(doc_type, [])
    wanted = texts.where(F.col("level").isin(levels)).join(keys.select(F.col("vbeln").alias("doc_key")).distinct(), "doc_key", "left_semi")
    return wanted.select("doc_key", F.when(F.col("level") == "item", "item").otherwise("header").alias("level"), F.when(F.col("level") == "item", F.col("posnr")).alias("posnr"), "lang", "text", F.col("changed").alias("changed_at"))


def search_texts(texts: DataFrame, pattern: str, doc_type: str | None = None, since: str | None = None, until: str | None = None, orgs: list[str] | None = None, limit: int = 200) -> DataFrame:
    """search_doc_text over texts of a kind (order, item, delivery), a span of dates and some organisations."""
    found = texts
    if doc_type:
        found = found.where(F.col("level") == {"order": "header", "sales": "header"}.get(doc_type, doc_type))
    if since:
        found = found.where(F.col("changed") >= F.lit(since).cast("date"))
    if until:
        found = found.where(F.col("changed") <= F.lit(until).cast("date"))
    if orgs:
        found = found.where(F.col("vkorg").isin(orgs))
    return search_doc_text(found, pattern, "doc_key", limit=limit)


def label_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_key") -> DataFrame:
    """documents with the cluster of each; those without one have none."""
    return documents.join(labels.select(key, "cluster"), key, "left")


def risk_of(p: Column) -> Column:
    """The scale of four levels that documents are told by."""
    return F.when(p >= 0.9, "critical").when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


#: Organisations that deliver well, and order types that are looked at.
GOOD_ORGS, SPECIAL_TYPES = ["1200", "1300"], ["ZOR", "ZSTO"]
RISK = "doc_number string, prediction_type string, probability double, predicted_value double, risk_level string, factors string"


def document_risk(orders: DataFrame, reach: DataFrame, deliveries: DataFrame, as_of: str, good_orgs: list[str] = GOOD_ORGS, special: list[str] = SPECIAL_TYPES) -> DataFrame:
    """Three rows an order: late_delivery, credit_hold and completion_time, from its value, type, customer and age, and
    from the documents that follow it. A customer's standing is the sum of its number's characters, modulo ten."""
    below = reach.where("depth > 0").groupBy(F.col("root").alias("vbeln")).agg(
        F.count("*").alias("_flow"), F.bool_or(F.col("category") == "J").alias("_delivered"), F.bool_or(F.col("category") == "M").alias("_billed"), F.min(F.when(F.col("category") == "J", F.col("document"))).alias("delivery"),
    )
    wide = orders.join(below, "vbeln", "left").join(deliveries.select("delivery", F.col("actual_gi").isNull().alias("_pending")), "delivery", "left")
    c, now = F.col, F.lit(as_of).cast("date")
    value, flow = F.coalesce(c("netwr").cast("double"), F.lit(0.0)), F.coalesce(c("_flow"), F.lit(0))
    digit = F.aggregate(F.split("kunnr", ""), F.lit(0), lambda a, x: a + F.ascii(x)) % 10
    no = F.lit(False)

    def total(base: float, parts: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
        score = reduce(lambda a, p: a + F.when(F.coalesce(p[1], no), p[2]).otherwise(0.0), parts, F.lit(base))
        names = F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(test, no), F.lit(name)) for name, test, _ in parts))), ",")
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4), names

    late, late_factors = total(0.3, [
        ("high_order_value", value > 100000, 0.15), ("medium_order_value", (value > 50000) & (value <= 100000), 0.08), ("no_downstream_docs", flow == 0, 0.2), ("partial_document_flow", (flow > 0) & (flow < 3), 0.1),
        ("pending_goods_issue", c("_pending"), 0.15), ("order_age", F.datediff(now, c("erdat")) > 14, 0.12), ("regional_risk", c("vkorg").isin(good_orgs), -0.1),
    ])
    credit, credit_factors = total(0.15, [
        ("exceptionally_high_value", value > 200000, 0.25), ("high_value_order", (value > 100000) & (value <= 200000), 0.15), ("customer_credit_history", digit < 2, 0.2), ("customer_credit_standing", digit > 7, -0.1),
        ("order_type_risk", c("auart").isin(special), 0.1),
    ])
    days = F.lit(7) + F.when(value > 100000, 5).when(value > 50000, 3).otherwise(0)
    days = F.when(c("_billed"), F.greatest(F.lit(1), days - 4)).when(c("_delivered"), F.greatest(F.lit(2), days - 2)).when(flow == 0, days + 3).otherwise(days)
    days = days + F.when(F.month(now).isin(12, 1), 2).otherwise(0)
    sure = F.lit(0.84) - F.when(days > 14, 0.1).otherwise(0.0) - F.when(flow == 0, 0.05).otherwise(0.0)
    why = F.array_join(F.array_compact(F.array(F.when(value > 50000, "order_complexity"), F.when(F.coalesce(c("_billed") | c("_delivered"), no) | (flow == 0), "process_progress"), F.when(F.month(now).isin(12, 1), "seasonal_factor"))), ",")
    slow = F.when(days > 21, "critical").when(days > 14, "high").when(days > 7, "medium").otherwise("low")
    row = lambda kind, p, v, level, factors: F.struct(F.lit(kind).alias("prediction_type"), p.alias("probability"), v.cast("double").alias("predicted_value"), level.alias("risk_level"), factors.alias("factors"))
    rows = F.array(
        row("late_delivery", late, (late >= 0.5).cast("int"), risk_of(late), late_factors), row("credit_hold", credit, (credit >= 0.5).cast("int"), risk_of(credit), credit_factors),
        row("completion_time", F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.95), sure)), 4), days, slow, why),
    )
    return wide.select(F.col("vbeln").alias("doc_number"), F.explode(rows).alias("r")).select("doc_number", "r.*")


#: Levels from worst to best, and what to do about a prediction.
LEVELS = ["critical", "high", "medium", "low", "minimal"]
ACTIONS = {
    "late_delivery": ["Review order priority and expedite if needed", "Check inventory availability and reserve stock", "Contact logistics for delivery optimization", "Communicate proactively with customer"],
    "credit_hold": ["Review customer credit status immediately", "Request advance payment if appropriate", "Escalate to credit management team", "Verify customer payment terms"],
    "completion_time": ["Identify process bottlenecks", "Allocate additional resources if needed", "Review delivery schedule with customer", "Monitor document flow progress"],
}


def by_level(column: str = "risk_level") -> Column:
    """The place of a level, worst first; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LEVELS)), F.col(column)), F.lit(0)), F.lit(len(LEVELS) + 1))


def document_alerts(found: DataFrame, threshold: float = 0.7, top: int | None = None) -> DataFrame:
    """Alerts of document_risk at or above a probability, with message and actions, the worst first."""
    percent = F.round(F.col("probability") * 100, 0).cast("int")
    said = (
        F.when(F.col("prediction_type") == "late_delivery", F.format_string("High risk of late delivery (%d%% probability)", percent))
        .when(F.col("prediction_type") == "credit_hold", F.format_string("Order likely to be placed on credit hold (%d%% probability)", percent))
        .otherwise(F.format_string("Extended completion time expected: %d days", F.col("predicted_value").cast("int")))
    )
    actions = F.create_map(*(x for kind, list_ in ACTIONS.items() for x in (F.lit(kind), F.lit("; ".join(list_)))))[F.col("prediction_type")]
    alerts = found.where(F.col("probability") >= threshold).select("doc_number", F.col("prediction_type").alias("alert_type"), F.col("risk_level").alias("severity"), "probability", said.alias("message"), actions.alias("recommended_actions"))
    ordered = alerts.orderBy(by_level("severity"), F.desc("probability"), "doc_number", "alert_type")
    return ordered.limit(top) if top else ordered


def risk_alerts(found: DataFrame, least: str = "high", kinds: list[str] | None = None) -> DataFrame:
    """Alerts of case predictions (case_id, prediction_type, probability, risk_level, remaining_hours) at a level or worse:
    immediate action, warning or monitoring, with a message."""
    worst = found.where(by_level() <= LEVELS.index(least) + 1)
    worst = worst.where(F.col("prediction_type").isin(kinds)) if kinds else worst
    urgent, percent, days = F.col("risk_level") == "critical", F.round(F.col("probability") * 100, 0).cast("int"), F.round(F.col("remaining_hours") / 24, 0).cast("int")
    text = lambda head, calm, grave, n: F.when(urgent, F.format_string(f"CRITICAL: Case %s {head}. {grave}", "case_id", n)).otherwise(F.format_string(f"Case %s {calm}.", "case_id", n))
    said = (
        F.when(F.col("prediction_type") == "late_delivery", text("has %d%% probability of late delivery", "has %d%% probability of late delivery", "Immediate action required.", percent))
        .when(F.col("prediction_type") == "credit_hold", text("has %d%% probability of credit hold", "has %d%% probability of being put on credit hold", "Review immediately.", percent))
        .otherwise(text("estimated to take %d more days", "estimated to complete in %d days", "Exceeds SLA threshold.", days))
    )
    kind = F.when(urgent, "immediate_action").when(F.col("risk_level") == "high", "risk_warning").otherwise("monitoring")
    return worst.select("case_id", kind.alias("alert_type"), "prediction_type", "risk_level", "probability", said.alias("message"))


def sort_alerts(alerts: DataFrame, least: str | None = None, top: int | None = None) -> DataFrame:
    """Alerts by severity, then probability and time, with a least severity and a limit if wished."""
    kept = alerts.where(by_level("severity") <= LEVELS.index(least) + 1) if least else alerts
    time = [F.desc(c) for c in ("ts",) if c in alerts.columns]
    ordered = kept.orderBy(by_level("severity"), F.desc("probability"), *time, *(c for c in ("case_id", "doc_number", "alert_type") if c in alerts.columns))
    return ordered.limit(top) if top else ordered


def handoffs(log: DataFrame) -> DataFrame:
    """case_id, n_resources and resource_changes: how often an event with a resource follows one of another resource."""
    named = log.where("resource is not null")
    order = Window.partitionBy("case_id").orderBy("ts", "event_id", "activity")
    changed = named.select("case_id", "resource", (F.lag("resource").over(order) != F.col("resource")).alias("_c"))
    counts = changed.groupBy("case_id").agg(F.countDistinct("resource").alias("n_resources"), F.count_if("_c").alias("resource_changes"))
    none = F.lit(0).cast("long")
    return log.select("case_id").distinct().join(counts, "case_id", "left").select("case_id", F.coalesce("n_resources", none).alias("n_resources"), F.coalesce("resource_changes", none).alias("resource_changes"))


def recent_activities(log: DataFrame) -> DataFrame:
    """case_id, current_activity and previous_activity: the last two of each case."""
    two = Window.partitionBy("case_id").orderBy(F.desc("ts"), F.desc("event_id"), F.desc("activity"))
    last = log.select("case_id", "activity", F.row_number().over(two).alias("_n")).where("_n <= 2")
    return last.groupBy("case_id").agg(F.max(F.when(F.col("_n") == 1, F.col("activity"))).alias("current_activity"), F.max(F.when(F.col("_n") == 2, F.col("activity"))).alias("previous_activity"))


def filter_values(cards: DataFrame, facets: list[str]) -> DataFrame:
    """facet, value, n: the distinct values that cards can be browsed by, and how many cards have each."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in facets)))
    return cards.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def process_context(log: DataFrame) -> DataFrame:
    """One row on a log: events, cases, activities, resources, and the first and last time."""
    return log.agg(F.count("*").alias("n_events"), F.countDistinct("case_id").alias("n_cases"), F.countDistinct("activity").alias("n_activities"), F.countDistinct("resource").alias("n_resources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


#: Purchase patterns, the activities they are told by and how sure they are.
PURCHASE_PATTERNS = [
    ("3-Way Match Compliance", ["Record Goods Receipt", "Record Invoice Receipt", "Clear Invoice"], "HIGH"),
    ("Vendor Invoice Blocking", ["Vendor creates invoice", "Change Price", "Change Quantity"], "HIGH"),
    ("Late Goods Receipt", ["Record Invoice Receipt", "Record Goods Receipt"], "MEDIUM"),
    ("Maverick Buying Detection", ["Create Purchase Order Item"], "MEDIUM"),
    ("Payment Block Pattern", ["SRM: Awaiting Approval", "Delete Purchase Order Item"], "MEDIUM"),
    ("Excessive Changes", ["Change Quantity", "Change Price", "Change Approval for Purchase Order"], "MEDIUM"),
]
REQUISITION = "Create Purchase Requisition Item"


def process_patterns(log: DataFrame, patterns: list[tuple] = PURCHASE_PATTERNS, requisition: str = REQUISITION) -> DataFrame:
    """name, confidence, n_cases: in how many cases each pattern really occurs. A match has all its activities; late
    goods come after the first invoice; maverick orders have no requisition; changes are two or more; of the others
    any activity will do."""
    names = sorted({a for _, acts, _ in patterns for a in acts} | {requisition})
    first = [F.min(F.when(F.col("activity") == a, F.struct("ts", "event_id"))).alias(f"f{i}") for i, a in enumerate(names)]
    count = [F.count_if(F.col("activity") == a).alias(f"n{i}") for i, a in enumerate(names)]
    cases = log.where(F.col("activity").isin(names)).groupBy("case_id").agg(*first, *count)
    at = {a: i for i, a in enumerate(names)}

    def holds(name: str, acts: list[str]) -> Column:
        has = [F.col(f"f{at[a]}").isNotNull() for a in acts]
        if name.startswith("3-Way"):
            return reduce(lambda a, b: a & b, has)
        if name.startswith("Late"):
            return F.coalesce(F.col(f"f{at[acts[1]]}") > F.col(f"f{at[acts[0]]}"), F.lit(False))
        if name.startswith("Maverick"):
            return has[0] & F.col(f"f{at[requisition]}").isNull()
        if name.startswith("Excessive"):
            return reduce(lambda a, b: a + b, (F.col(f"n{at[a]}") for a in acts)) >= 2
        return reduce(lambda a, b: a | b, has)

    counts = cases.agg(*(F.count_if(holds(name, acts)).alias(f"p{i}") for i, (name, acts, _) in enumerate(patterns)))
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(sure).alias("confidence"), F.col(f"p{i}").alias("n_cases")) for i, (name, _, sure) in enumerate(patterns))))
    return counts.select(rows.alias("r")).select("r.*")


def high_risk_cases(found: DataFrame, least: float = 0.6) -> DataFrame:
    """Cases whose worst prediction (case_id, prediction_type, probability) reaches a probability, worst first."""
    worst = F.max(F.struct("probability", "prediction_type"))
    cases = found.groupBy("case_id").agg(worst.alias("w")).select("case_id", F.col("w.prediction_type").alias("prediction_type"), F.col("w.probability").alias("probability"))
    return cases.where(F.col("probability") >= least)
