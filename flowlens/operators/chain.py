"""The document chain: orders, deliveries, invoices, document flow, timing and lookups.

Orders have vbeln, erdat, vdatu, vkorg, ...; deliveries have delivery, vbeln, created, actual_gi; invoices have
invoice, delivery, billing_date; flow edges have vbelv, vbtyp_v, vbeln, vbtyp_n. Joins are equi joins on keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def day_difference(start: Column, end: Column) -> Column:
    """Whole days between two times, rounded down."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / F.lit(86_400_000_000)).cast("int")


def order_deliveries(deliveries: DataFrame, flow: DataFrame) -> DataFrame:
    """(vbeln, delivery) from the deliveries' own reference and from flow edges C to J, each pair once."""
    edges = flow.where("vbtyp_v = 'C' and vbtyp_n = 'J'").select(F.col("vbelv").alias("vbeln"), F.col("vbeln").alias("delivery"))
    return deliveries.select("vbeln", "delivery").union(edges).distinct()


def delivery_invoices(invoices: DataFrame, flow: DataFrame) -> DataFrame:
    edges = flow.where("vbtyp_v = 'J' and vbtyp_n = 'M'").select(F.col("vbelv").alias("delivery"), F.col("vbeln").alias("invoice"))
    return invoices.select("delivery", "invoice").union(edges).distinct()


def unified_documents(orders: DataFrame, deliveries: DataFrame, invoices: DataFrame, flow: DataFrame) -> DataFrame:
    """One row per order: numbers of its deliveries and invoices, actual dates and the four day differences.
    The delivery date is the first of actual goods issue, else creation; the invoice date the first billing date."""
    of_order = order_deliveries(deliveries, flow)
    shipped = of_order.join(deliveries.select("delivery", F.coalesce("actual_gi", "created").alias("day")), "delivery").groupBy("vbeln").agg(F.countDistinct("delivery").alias("n_deliveries"), F.min("day").alias("delivery_date"))
    billed = delivery_invoices(invoices, flow).join(of_order, "delivery").select("vbeln", "invoice").distinct()
    billed = billed.join(invoices.select("invoice", "billing_date"), "invoice").groupBy("vbeln").agg(F.countDistinct("invoice").alias("n_invoices"), F.min("billing_date").alias("invoice_date"))
    wide = orders.join(shipped, "vbeln", "left").join(billed, "vbeln", "left")
    return wide.select(
        F.col("vbeln").alias("doc_key"), "vkorg", "industry", "erdat", "vdatu", "delivery_date", "invoice_date",
        F.coalesce("n_deliveries", F.lit(0)).alias("n_deliveries"), F.coalesce("n_invoices", F.lit(0)).alias("n_invoices"), *timing_metrics("erdat", "vdatu", "delivery_date", "invoice_date"),
    )


def timing_metrics(created: str, wanted: str, delivered: str, invoiced: str) -> list[Column]:
    """Order to delivery, delay against the wished date, invoice lag, order to invoice, in days."""
    pairs = {"order_to_delivery_days": (created, delivered), "delivery_delay_days": (wanted, delivered), "invoice_lag_days": (delivered, invoiced), "order_to_invoice_days": (created, invoiced)}
    return [day_difference(F.col(a), F.col(b)).alias(name) for name, (a, b) in pairs.items()]


def doc_flow(flow: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, document, category, depth) of every document reachable from each root, each once, at its least depth.
    Joins go on from the pairs that are new until none is; cycles end there."""
    edges = checkpointed(flow.select(F.col("vbelv").alias("_from"), F.col("vbeln").alias("document"), F.col("vbtyp_n").alias("category")).distinct())
    level = checkpointed(roots.select(F.col("vbeln").alias("root"), F.col("vbeln").alias("document"), F.lit("C").alias("category"), F.lit(0).alias("depth")).distinct())
    found, depth = level, 0
    while not level.isEmpty():
        depth += 1
        met = level.select("root", F.col("document").alias("_from")).join(edges, "_from").groupBy("root", "document").agg(F.min("category").alias("category"))
        level = checkpointed(met.join(found, ["root", "document"], "left_anti").select("root", "document", "category", F.lit(depth).alias("depth")))
        found = found.unionByName(level)
    return found


#: Category of a log row by a word in its activity, the first that fits.
CATEGORY_WORDS = [("invoice", "M"), ("goods", "R"), ("delivery", "J"), ("order", "C")]


def log_doc_flow(log: DataFrame) -> DataFrame:
    """Event rows as flow entries with a category by activity word."""
    activity = F.lower("activity")
    category = F.coalesce(*(F.when(activity.contains(word), code) for word, code in CATEGORY_WORDS), F.lit("X"))
    position = F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "event_id", "activity"))
    return log.select(F.col("case_id").alias("document"), "activity", category.alias("category"), "ts", position.alias("position"))


def delivery_timing(deliveries: DataFrame, orders: DataFrame) -> DataFrame:
    wanted = orders.select("vbeln", F.col("vdatu").alias("requested_date"))
    return deliveries.join(wanted, "vbeln", "left").select("delivery", "vbeln", "requested_date", F.col("created").alias("planned_gi"), "actual_gi", day_difference(F.col("requested_date"), F.col("actual_gi")).alias("delay_days"))


def invoice_timing(invoices: DataFrame, deliveries: DataFrame) -> DataFrame:
    joined = invoices.join(deliveries.select("delivery", "vbeln"), "delivery", "left")
    return joined.groupBy("invoice", "billing_date").agg(F.array_sort(F.collect_set("delivery")).alias("_d"), F.array_sort(F.collect_set("vbeln")).alias("_o")).select("invoice", "billing_date", F.array_join("_d", ",").alias("deliveries"), F.array_join("_o", ",").alias("orders"))


def documents_by_org(orders: DataFrame, org: str) -> DataFrame:
    return orders.where(F.col("vkorg") == org)


def sales_orgs(orders: DataFrame) -> DataFrame:
    return orders.select("vkorg").distinct()


def sales_header(orders: DataFrame, keys: DataFrame) -> DataFrame:
    """Headers of a set of documents (column vbeln)."""
    return orders.join(keys.select("vbeln").distinct(), "vbeln", "left_semi")


def sales_items(items: DataFrame, keys: DataFrame) -> DataFrame:
    return items.join(keys.select("vbeln").distinct(), "vbeln", "left_semi")


def items_of_orders(items: DataFrame) -> DataFrame:
    """Items as one sorted array per order."""
    return items.groupBy("vbeln").agg(F.array_sort(F.collect_list(F.struct("posnr", "matnr", "kwmeng", "netwr"))).alias("items"))


def master_stub(master: DataFrame, key: str, kept: list[str], hashed: bool = True, salt: str = "") -> DataFrame:
    """Safe attributes of master rows; the key as the first 16 hex digits of its hash, if wished."""
    named = F.substring(F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256), 1, 16) if hashed else F.col(key)
    return master.select(named.alias("id"), *kept)


def strip_fields(df: DataFrame, allowed: set[str], forbidden: set[str] = frozenset()) -> DataFrame:
    return df.select(*(c for c in df.columns if c in allowed and c not in forbidden))


def limit_rows(df: DataFrame, order: list, requested: int | None = None, default: int = 200, most: int = 1000) -> DataFrame:
    """The first rows in a stated order, at most `most`, and whether there were more."""
    n = min(requested or default, most)
    kept = df.orderBy(*order).limit(n + 1)
    count = kept.agg((F.count("*") > n).alias("truncated"))
    return kept.orderBy(*order).limit(n).crossJoin(F.broadcast(count))


def search_doc_text(texts: DataFrame, pattern: str, key: str, text: str = "text", limit: int = 200, around: int = 50) -> DataFrame:
    """Rows whose text matches, with the matches per word as a score and a snippet around the first match."""
    t, n = F.col(text), F.regexp_count(F.col(text), F.lit(f"(?i){pattern}"))
    words = F.size(F.split(F.trim(t), r"\s+"))
    first = F.regexp_instr(t, F.lit(f"(?i){pattern}"))
    start = F.greatest(first - around, F.lit(1))
    size = F.length(F.regexp_substr(t, F.lit(f"(?i){pattern}"))) + 2 * around
    snippet = F.concat(F.when(start > 1, "...").otherwise(""), t.substr(start, size), F.when(start + size <= F.length(t), "...").otherwise(""))
    found = texts.where(t.rlike(f"(?i){pattern}")).select(F.col(key).alias("doc_key"), n.alias("n_matches"), F.round(n / words, 6).alias("score"), snippet.alias("snippet"))
    return found.orderBy(F.desc("score"), "doc_key").limit(limit)


def search_attributes(orders: DataFrame, pattern: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Orders whose joined attributes match and whose dates touch the span."""
    joined = F.concat_ws(" ", "auart", "vkorg", "kunnr", "industry")
    found = orders.where(joined.rlike(f"(?i){pattern}"))
    found = found.where(F.col("vdatu") >= F.lit(since).cast("date")) if since else found
    found = found.where(F.col("erdat") <= F.lit(until).cast("date")) if until else found
    return found.select("vbeln", joined.alias("attributes"))


def orders_from_event_log(log: DataFrame, create: list[str], receipt: list[str], invoice: list[str]) -> DataFrame:
    """Per case: first creation, receipt and invoice times and the number of resources."""
    first = lambda names: F.min(F.when(F.col("activity").isin(names), F.col("ts")))
    return log.groupBy(F.col("case_id").alias("document")).agg(first(create).alias("created_ts"), first(receipt).alias("receipt_ts"), first(invoice).alias("invoice_ts"), F.countDistinct("resource").alias("n_resources"))


def map_activities(log: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The log with canonical activity names; unknown ones stay."""
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return log.withColumn("activity", F.coalesce(names[F.col("activity")], F.col("activity")))


def flow_entries_to_documents(flow: DataFrame) -> DataFrame:
    """Documents of the flow with their category's name and their predecessors."""
    label = category_label(F.col("vbtyp_n"))
    return flow.groupBy(F.col("vbeln").alias("document"), label.alias("category")).agg(F.array_sort(F.collect_set("vbelv")).alias("_p"), F.min("erdat").alias("created")).select("document", "category", F.array_join("_p", ",").alias("predecessors"), "created")


#: Names of document categories.
CATEGORIES = {"A": "Inquiry", "B": "Quotation", "C": "Order", "H": "Returns", "J": "Delivery", "K": "Credit memo request", "L": "Debit memo request", "M": "Invoice", "N": "Invoice cancellation", "O": "Credit memo", "P": "Debit memo", "R": "Goods movement"}


def category_label(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    return F.coalesce(names[code], code)
