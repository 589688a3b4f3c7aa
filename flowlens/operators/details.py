"""Whole documents and what stands behind a number: ledger documents with their lines, orders with all that follows,
purchase documents of a log, the reasons of a risk, evidence with its warnings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import format_duration, normalize_activity
from .chain import delivery_invoices, order_deliveries, timing_metrics
from .shared import checkpointed
from .ledger import KEY, account_texts, origin_document


def ledger_lines(head: DataFrame, lines: DataFrame, ska1: DataFrame, skat: DataFrame) -> DataFrame:
    """Lines of ledger documents with a column for debit and one for credit, the account's text, and their place."""
    debit, amount = F.col("SHKZG") == "S", F.abs("WRBTR")
    texts = account_texts(ska1, skat).select("HKONT", F.col("account_text").alias("account_description"))
    place = Window.partitionBy(*KEY).orderBy("BUZEI", "HKONT", "SHKZG", "WRBTR")
    found = lines.join(head.select(*KEY), KEY, "left_semi").withColumn("position", F.row_number().over(place)).join(texts, "HKONT", "left")
    return found.select(*KEY, "position", "BUZEI", "HKONT", "account_description", F.when(debit, amount).alias("debit_amount"), F.when(~debit, amount).alias("credit_amount"))


def ledger_documents(head: DataFrame, lines: DataFrame, ska1: DataFrame, skat: DataFrame) -> DataFrame:
    """Ledger documents whole: the header's columns, `line_items` in order, totals, whether they balance, the origin.
    Documents without lines have none and balance. Filter `head` to get one document."""
    item = F.struct("position", "BUZEI", "HKONT", "account_description", "debit_amount", "credit_amount")
    zero = F.lit(0).cast("decimal(38,2)")
    of_document = ledger_lines(head, lines, ska1, skat).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(item)).alias("line_items"), F.coalesce(F.sum("debit_amount"), zero).alias("_d"), F.coalesce(F.sum("credit_amount"), zero).alias("_c")
    )
    whole = head.join(of_document, KEY, "left")
    debit, credit = (F.round(F.coalesce(F.col(c), zero), 2) for c in ("_d", "_c"))
    return whole.select(
        *head.columns, F.coalesce("line_items", F.array().cast(of_document.schema["line_items"].dataType)).alias("line_items"), debit.alias("total_debit"), credit.alias("total_credit"),
        (F.abs(debit - credit) < 0.01).alias("is_balanced"), origin_document(F.col("AWTYP"), F.col("AWKEY")).alias("origin_document"),
    )


def whole_orders(orders: DataFrame, deliveries: DataFrame, invoices: DataFrame, flow: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Orders with their deliveries and invoices as sorted arrays, the customer and the dates as structs, the timing and,
    where texts (doc_key, consolidated_text) are given, the text. An invoice of many deliveries stands once."""
    of_order = order_deliveries(deliveries, flow)
    sent = of_order.join(deliveries.drop("vbeln"), "delivery").groupBy("vbeln").agg(F.array_sort(F.collect_set(F.struct("delivery", "created", "actual_gi", "status"))).alias("deliveries"))
    billed = delivery_invoices(invoices, flow).join(of_order, "delivery").select("vbeln", "invoice").distinct().join(invoices.select("invoice", "billing_date").distinct(), "invoice")
    billed = billed.groupBy("vbeln").agg(F.array_sort(F.collect_set(F.struct("invoice", "billing_date"))).alias("invoices"))
    wide = orders.join(sent, "vbeln", "left").join(billed, "vbeln", "left")
    none = {name: F.array().cast(df.schema[name].dataType) for df, name in ((sent, "deliveries"), (billed, "invoices"))}
    wide = wide.withColumns({name: F.coalesce(name, empty) for name, empty in none.items()})
    first = F.array_min(F.transform("deliveries", lambda d: F.coalesce(d["actual_gi"], d["created"])))
    wide = wide.withColumns({"delivery_date": first, "invoice_date": F.array_min(F.col("invoices.billing_date"))})
    made = wide.select(
        F.col("vbeln").alias("doc_key"), F.struct(*orders.columns).alias("order"), "deliveries", "invoices", F.struct(F.col("kunnr").alias("customer_id"), "industry").alias("customer"),
        F.struct(F.col("erdat").alias("created"), F.col("vdatu").alias("requested"), "delivery_date", "invoice_date").alias("dates"), F.struct(*timing_metrics("erdat", "vdatu", "delivery_date", "invoice_date")).alias("timing"),
        F.col("vkorg").alias("sales_org"), F.col("industry").alias("customer_industry"), F.size("deliveries").alias("n_deliveries"), F.size("invoices").alias("n_invoices"),
    )
    return made if texts is None else made.join(texts.select("doc_key", "consolidated_text"), "doc_key", "left").withColumn("consolidated_text", F.coalesce("consolidated_text", F.lit("")))


#: Words of activities that create, receive and bill a purchase.
CREATES, RECEIVES, BILLS = ("Create", "Record Purchase Order"), ("Goods Receipt", "Receive Goods"), ("Invoice",)


def _holds(activity: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (activity.contains(w) for w in words))


def purchase_documents(log: DataFrame, item: str = "item", category: str = "item_category", vendor: str = "vendor", company: str = "company", kind: str = "document_type") -> DataFrame:
    """A row a purchase document (case_id) of a log: first times of creation, receipt and bill, its distinct items, and
    the numbers of the receipt and the bill where there are some. Columns that the log lacks are empty."""
    have = lambda c, other="": F.col(c) if c in log.columns else F.lit(other)
    at = lambda words: F.min(F.when(_holds(F.col("activity"), words), F.col("ts")))
    first = F.struct("ts", "event_id") if "event_id" in log.columns else F.struct("ts")
    number, group = have(item).cast("string"), have(category).cast("string")
    own = log.where("ts is not null")
    items = own.where(number.isNotNull() & (number != "")).groupBy("case_id", number.alias("_i")).agg(F.min_by(group, first).alias("_c")).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("item_number"), F.col("_c").alias("item_category")))).alias("items"))
    heads = own.groupBy("case_id").agg(
        at(CREATES).alias("created_ts"), at(RECEIVES).alias("receipt_ts"), at(BILLS).alias("invoice_ts"),
        *(F.min_by(have(c, other), first).alias(name) for name, c, other in (("order_type", kind, "NB"), ("customer", vendor, ""), ("sales_org", company, ""))),
    )
    whole = heads.join(items, "case_id", "left")
    return whole.select(
        F.col("case_id").alias("document_number"), "created_ts", "order_type", "customer", "sales_org", F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"),
        F.when(F.col("receipt_ts").isNotNull(), F.concat(F.lit("GR"), "case_id")).alias("receipt_number"), "receipt_ts", F.when(F.col("invoice_ts").isNotNull(), F.concat(F.lit("IR"), "case_id")).alias("invoice_number"), "invoice_ts",
    )


def purchase_flow(documents: DataFrame) -> DataFrame:
    """preceding_doc, subsequent_doc and their categories: order to receipt, and to the bill from the receipt, else from the order."""
    edge = lambda a, b, x, y: F.struct(a.alias("preceding_doc"), b.alias("subsequent_doc"), x.alias("preceding_category"), F.lit(y).alias("subsequent_category"))
    number, receipt, bill = F.col("document_number"), F.col("receipt_number"), F.col("invoice_number")
    edges = F.array(F.when(receipt.isNotNull(), edge(number, receipt, F.lit("F"), "R")), F.when(bill.isNotNull(), edge(F.coalesce(receipt, number), bill, F.when(receipt.isNotNull(), "R").otherwise("F"), "P")))
    return documents.select(F.explode(F.array_compact(edges)).alias("e")).select("e.*")


#: Other names of milestones.
VARIATIONS = {
    "order_created": ["create_sales_order", "sales_order_created", "so_created"],
    "delivery_created": ["create_delivery", "outbound_delivery"],
    "goods_issued": ["goods_issue", "post_goods_issue", "pgi"],
    "invoice_created": ["create_invoice", "billing_document"],
    "credit_check": ["credit_check", "check_credit"],
    "credit_hold": ["credit_block", "blocked_credit"],
    "purchase_order": ["create_purchase_order", "po_created", "create_po"],
    "goods_receipt": ["record_goods_receipt", "gr_posted", "post_gr"],
    "service_entry": ["record_service_entry", "ses_created"],
    "invoice_receipt": ["record_invoice_receipt", "ir_posted"],
}


def matches_milestone(activity: Column, milestone: str) -> Column:
    """Whether an activity is a milestone, in other words too: one name, normalised, holds the other or a variation."""
    a = normalize_activity(activity)
    names = [milestone, *VARIATIONS.get(milestone, [])]
    return (a != "") & reduce(lambda x, y: x | y, (a.contains(n) | F.lit(n).contains(a) for n in names))


def milestones_of(activity: Column, milestones: list[str] | None = None) -> Column:
    """The milestones that an activity is, as an array."""
    return F.array_compact(F.array(*(F.when(matches_milestone(activity, m), F.lit(m)) for m in milestones or VARIATIONS)))


def with_milestones(log: DataFrame, milestones: list[str]) -> DataFrame:
    """The log with `milestone`, the first that the activity is. Each different name is looked at once."""
    names = log.select("activity").distinct().withColumn("milestone", F.get(milestones_of(F.col("activity"), milestones), F.lit(0)))
    return log.join(names, "activity", "left")


#: Why a prediction counts in a risk or doesn't.
REASONS = {
    "probability": "True probability from classifier", "sla": "Converted to SLA ratio (SLA={}h)", "no_sla": "Excluded: no SLA provided for conversion",
    "raw": "Excluded: RAW value with no conversion context", "heuristic": "Excluded: heuristic scores not mixed with probabilities", "other": "Included as ",
}


def risk_breakdown(found: DataFrame, sla_hours: float | None = None) -> DataFrame:
    """Each prediction (case_id, prediction_type, value, value_type) with whether it counts, why, and what it adds."""
    kind, hours = F.col("value_type"), F.col("prediction_type") == "completion_time"
    sla = F.lit(REASONS["sla"].format(sla_hours)) if sla_hours else F.lit(REASONS["no_sla"])
    reason = F.when(kind == "probability", REASONS["probability"]).when((kind == "raw") & hours, sla).when(kind == "raw", REASONS["raw"]).when(kind == "heuristic", REASONS["heuristic"]).otherwise(F.concat(F.lit(REASONS["other"]), kind))
    counts = (kind != "heuristic") & ((kind != "raw") | (hours & F.lit(bool(sla_hours))))
    adds = F.when(kind == "raw", F.least(F.lit(1.0), F.col("value") / (sla_hours or 1.0))).otherwise(F.col("value"))
    return found.select("case_id", "prediction_type", "value_type", "value", counts.alias("is_included"), reason.alias("reason"), F.when(counts, F.round(adds, 6)).alias("risk_contribution"))


#: Fields that may leave a table, by kind of document.
ALLOWED_FIELDS = {
    "sales_header": "VBELN AUART VKORG VTWEG SPART KUNNR KUNWE AUDAT VDATU ERNAM ERDAT ERZET AENAM AEDAT GBSTK NETWR WAERK BSTNK",
    "sales_item": "VBELN POSNR MATNR ARKTX WERKS LGORT KWMENG VRKME NETWR WAERK PSTYV ABGRU EDATU KBMENG LIFSP FAKSP",
    "sales_text": "VBELN POSNR TDID SPRAS TEXT AENAM AEDAT",
    "delivery_header": "VBELN LFART VSTEL ROUTE KUNNR WADAT WADAT_IST LFDAT LDDAT TDDAT KOSTK WBSTK GBSTK BTGEW GEWEI ERNAM ERDAT ERZET",
    "delivery_item": "VBELN POSNR MATNR ARKTX WERKS LGORT LFIMG VRKME PIKMG VGBEL VGPOS CHARG",
    "invoice_header": "VBELN FKART FKDAT KUNRG KUNAG VKORG VTWEG SPART NETWR WAERK MWSBK BELNR GJAHR BUDAT FKSTO ERNAM ERDAT ERZET",
    "invoice_item": "VBELN POSNR MATNR ARKTX FKIMG VRKME NETWR WAERK VGBEL VGPOS AUBEL AUPOS WERKS",
    "master_customer": "ENTITY_TYPE ID HASHED_ID INDUSTRY REGION CATEGORY KTOKD ERDAT",
    "master_vendor": "ENTITY_TYPE ID HASHED_ID INDUSTRY REGION CATEGORY KTOKK ERDAT",
    "master_material": "ENTITY_TYPE ID HASHED_ID CATEGORY MTART MATKL SPART ERDAT",
    "doc_flow": "VBELV POSNV VBELN POSNN VBTYP_V VBTYP_N RFMNG RFWRT ERDAT ERZET",
}


def strip_document(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns that its kind of document may show, in their order there, names in any case."""
    allowed = set(ALLOWED_FIELDS[kind].split())
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.upper() in allowed))


def stripped_fields(df: DataFrame, kind: str) -> list[str]:
    """The columns that strip_document() takes away."""
    return [c for c in df.columns if c.upper() not in ALLOWED_FIELDS[kind].split()]


def purchase_stats(log: DataFrame) -> DataFrame:
    """Numbers of a purchase log: events, cases, documents, vendors, activities, resources and the span."""
    document = F.col("document_number") if "document_number" in log.columns else F.col("case_id")
    return log.agg(
        F.count("*").alias("n_events"), F.countDistinct("case_id").alias("n_cases"), F.countDistinct(document).alias("n_documents"), F.countDistinct("vendor").alias("n_vendors"),
        F.countDistinct("activity").alias("n_activities"), F.countDistinct("resource").alias("n_resources"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


#: Sizes and shares below which evidence is weak.
SMALL, MODERATE, TIMED, WITH_TEXT = 10, 30, 0.5, 0.8


def evidence(docs: DataFrame, fields: list[str], cluster: str = "cluster", timing: str = "order_to_delivery_days", text: str = "consolidated_text") -> DataFrame:
    """Of each cluster: its documents, how many have each field, and warnings on small samples and missing data, all in
    one pass."""
    here = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")) if c in docs.columns else F.lit(0).cast("long")
    counted = docs.groupBy(cluster).agg(F.count("*").alias("n"), *(here(f).alias(f"_{f}") for f in {*fields, timing, text}))
    n = F.col("n")
    warn = lambda when, kind, level, words, field=None: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(level).alias("level"), words.alias("message"), F.lit(field).cast("string").alias("field")))
    warnings = F.array_compact(F.array(
        warn(n < SMALL, "small_sample", "warning", F.format_string("Small sample size (%d documents). Results may not be reliable.", n)),
        warn((n >= SMALL) & (n < MODERATE), "small_sample", "info", F.format_string("Moderate sample size (%d documents). Interpret with caution.", n)),
        warn(F.col(f"_{timing}") < n * TIMED, "missing_data", "warning", F.format_string("Only %d/%d documents have complete timing data.", F.col(f"_{timing}"), n), timing),
        warn(F.col(f"_{text}") < n * WITH_TEXT, "missing_data", "warning", F.format_string("Only %d/%d documents have text content.", F.col(f"_{text}"), n), text),
    ))
    usage = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("n_present"), F.round(F.col(f"_{f}") / n, 4).alias("coverage")) for f in fields))
    return counted.select(cluster, "n", usage.alias("fields"), warnings.alias("warnings"))


def evidence_warnings(found: DataFrame, cluster: str = "cluster") -> DataFrame:
    return found.select(cluster, F.explode("warnings").alias("w")).select(cluster, "w.*")


#: How an edge of a level is drawn.
EDGE_STYLES = {"fast": "stroke:#22c55e,stroke-width:2px", "medium": "stroke:#eab308,stroke-width:3px", "slow": "stroke:#ef4444,stroke-width:4px"}


def filter_edges(edges: DataFrame, min_count: int = 1, levels: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Edges (from_activity, to_activity, n, level) that are frequent enough, of some levels, the most frequent ones."""
    kept = edges.where(F.col("n") >= min_count)
    kept = kept.where(F.col("level").isin(levels)) if levels else kept
    return kept.orderBy(F.desc("n"), "from_activity", "to_activity").limit(top) if top else kept


def styled_map_lines(edges: DataFrame, direction: str = "LR", title: str | None = None) -> DataFrame:
    """position, line of a flowchart of bottlenecks(): nodes, edges with their mean time and number, and a style for each
    edge by its level. The edges are already aggregated: as many as pairs of activities."""
    edges = checkpointed(edges)  # few rows, used four times
    ident = lambda c: F.regexp_replace(c, r"\W", "_")
    order = Window.orderBy("from_activity", "to_activity")
    placed = edges.withColumn("_i", F.row_number().over(order) - 1)
    nodes = edges.select(F.col("from_activity").alias("a")).union(edges.select("to_activity")).distinct()
    named = nodes.select(F.lit(1).alias("block"), F.row_number().over(Window.orderBy("a")).cast("int").alias("at"), F.concat(F.lit("    "), ident(F.col("a")), F.lit("(["), F.regexp_replace("a", "_", " "), F.lit("])")).alias("line"))
    label = F.concat(format_duration(F.col("mean_hours")), F.when(F.col("n") > 1, F.concat(F.lit(", n="), F.col("n").cast("string"))).otherwise(""))
    drawn = placed.select(F.lit(2).alias("block"), F.col("_i").alias("at"), F.concat(F.lit("    "), ident(F.col("from_activity")), F.lit(" --> |"), label, F.lit("| "), ident(F.col("to_activity"))).alias("line"))
    style = F.create_map(*(F.lit(x) for pair in EDGE_STYLES.items() for x in pair))[F.col("level")]
    styles = placed.where(style.isNotNull()).select(F.lit(3).alias("block"), F.col("_i").alias("at"), F.concat(F.lit("    linkStyle "), F.col("_i").cast("string"), F.lit(" "), style).alias("line"))
    head = [(0, i, line) for i, line in enumerate([*(["---", f"title: {title}", "---"] if title else []), f"flowchart {direction}"])]
    lines = edges.sparkSession.createDataFrame(head, "block int, at int, line string").union(named).union(drawn).union(styles)
    return lines.select((F.row_number().over(Window.orderBy("block", "at")) - 1).alias("position"), "line")
