"""Object-centric event logs: objects, events and their relations as four tables.

Ids of events are hashes of type, object and time, so no global numbering is needed.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def objects(orders: DataFrame, items: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """object_id, object_type of orders, items, customers, deliveries and invoices, each once."""
    row = lambda df, key, kind: df.select(key.cast("string").alias("object_id"), F.lit(kind).alias("object_type"))
    parts = [
        row(orders, F.col("vbeln"), "order"), row(items, F.concat_ws("-", "vbeln", "posnr"), "item"), row(orders, F.col("kunnr"), "customer"), row(deliveries, F.col("delivery"), "delivery"), row(invoices, F.col("invoice"), "invoice"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def events(orders: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """event_id, event_type, object_id, ts; only where there is a date. An invoice is posted in an event of its own if that
    is another day (posting_date)."""
    row = lambda df, key, kind, day: df.where(F.col(day).isNotNull()).select(F.lit(kind).alias("event_type"), F.col(key).alias("object_id"), F.to_timestamp(day).alias("ts"))
    parts = [row(orders, "vbeln", "OrderCreated", "erdat"), row(deliveries, "delivery", "DeliveryCreated", "created"), row(deliveries, "delivery", "GoodsIssued", "actual_gi"), row(invoices, "invoice", "InvoiceCreated", "billing_date")]
    if "posting_date" in invoices.columns:
        parts.append(row(invoices.where("posting_date <> billing_date"), "invoice", "InvoicePosted", "posting_date"))
    return reduce(DataFrame.unionByName, parts).withColumn("event_id", F.substring(F.sha2(F.concat_ws("|", "event_type", "object_id", F.date_format("ts", "yyyy-MM-dd")), 256), 1, 16))


def object_relations(orders: DataFrame, items: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """source, target, qualifier of object pairs, in both directions, each once."""
    pair = lambda df, a, b, forth, back: df.select(a.alias("source"), b.alias("target"), F.lit(forth).alias("qualifier")).union(df.select(b.alias("source"), a.alias("target"), F.lit(back).alias("qualifier")))
    parts = [
        pair(items, F.col("vbeln"), F.concat_ws("-", "vbeln", "posnr"), "contains", "belongs_to"), pair(deliveries, F.col("vbeln"), F.col("delivery"), "fulfilled_by", "fulfills"),
        pair(invoices, F.col("delivery"), F.col("invoice"), "billed_by", "bills"), pair(orders, F.col("vbeln"), F.col("kunnr"), "placed_by", "placed"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def event_objects(found: DataFrame, deliveries: DataFrame, invoices: DataFrame) -> DataFrame:
    """event_id, object_id, qualifier: the object of each event, and the order behind deliveries and invoices."""
    own = found.select("event_id", "object_id", F.lit("subject").alias("qualifier"))
    behind = deliveries.select(F.col("delivery").alias("object_id"), F.col("vbeln").alias("order"))
    behind = behind.union(invoices.select("invoice", "delivery").join(deliveries.select("delivery", "vbeln"), "delivery").select("invoice", "vbeln"))
    return own.union(found.join(behind, "object_id").select("event_id", F.col("order").alias("object_id"), F.lit("order").alias("qualifier"))).distinct()


def ocel_stats(object_table: DataFrame, event_table: DataFrame) -> DataFrame:
    a = object_table.groupBy(F.col("object_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("object"))
    return a.unionByName(event_table.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("event")))


def objects_from_log(log: DataFrame) -> DataFrame:
    """Case and resource objects of a flat log, with their first and last event."""
    row = lambda key, kind: log.groupBy(F.col(key).alias("object_id")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_events")).withColumn("object_type", F.lit(kind))
    return row("case_id", "case").unionByName(row("resource", "resource"))


class Log(NamedTuple):
    """An object-centric log: objects (object_id, object_type, attributes), events (event_id, event_type, ts, attributes),
    event_objects (event_id, object_id, qualifier) and object_relations (source, target, qualifier)."""

    objects: DataFrame
    events: DataFrame
    event_objects: DataFrame
    object_relations: DataFrame


def _attributes(**values: Column) -> Column:
    """A map of the attributes that have a value."""
    pairs = F.map_from_arrays(F.array(*(F.lit(k) for k in values)), F.array(*(v.cast("string") for v in values.values())))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def invoice_state(activity: Column) -> Column:
    low = F.lower(activity)
    return F.when(low.contains("clear"), "cleared").when(low.contains("cancel"), "cancelled").when(low.contains("block"), "blocked").when(low.contains("create") | low.contains("record"), "posted").otherwise("pending")


def ocel_from_log(log: DataFrame, since: str | None = None, until: str | None = None) -> Log:
    """A purchase log (case_id, event_id, activity, ts, resource, vendor) as an object-centric one. Each case is a purchase
    order; events about goods receipts or invoices make such an object; an invoice belongs to the latest receipt before it."""
    kept = log.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else log
    kept = kept.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else kept
    low, number = F.lower("activity"), F.concat_ws("_", "case_id", F.col("event_id").cast("string"))
    order = Window.partitionBy("case_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.select(
        "*", F.concat_ws("_", F.lit("e"), number).alias("_e"), F.concat(F.lit("po_"), "case_id").alias("_po"), F.when(low.contains("goods receipt"), F.concat(F.lit("gr_"), number)).alias("_gr"),
        F.when(low.contains("invoice"), F.concat(F.lit("inv_"), number)).alias("_inv"),
    ).withColumn("_last", F.last("_gr", ignorenulls=True).over(order))
    cases = log.groupBy("case_id").agg(F.min("vendor").alias("vendor"))
    po, vendor = F.concat(F.lit("po_"), "case_id"), F.concat(F.lit("vendor_"), "vendor")
    objects = [
        cases.select(po.alias("object_id"), F.lit("purchase_order").alias("object_type"), _attributes(document_number=F.col("case_id"), vendor_id=F.col("vendor")).alias("attributes")),
        cases.where("vendor is not null").select(vendor.alias("object_id"), F.lit("vendor").alias("object_type"), _attributes(vendor_id=F.col("vendor")).alias("attributes")).dropDuplicates(["object_id"]),
        rows.where("_gr is not null").select(F.col("_gr").alias("object_id"), F.lit("goods_receipt").alias("object_type"), _attributes(posting_date=F.date_format("ts", "yyyy-MM-dd")).alias("attributes")),
        rows.where("_inv is not null").select(F.col("_inv").alias("object_id"), F.lit("invoice").alias("object_type"), _attributes(posting_date=F.date_format("ts", "yyyy-MM-dd"), status=invoice_state(F.col("activity"))).alias("attributes")),
    ]
    link = lambda df, key, kind, a="_e", name="event_id", b="object_id": df.where(F.col(key).isNotNull()).select(F.col(a).alias(name), F.col(key).alias(b), F.lit(kind).alias("qualifier"))
    e2o = [link(rows, "_po", "header"), link(rows, "_gr", "goods_receipt"), link(rows, "_inv", "invoice")]
    named = cases.where("vendor is not null").select(po.alias("_po"), vendor.alias("_v"))
    o2o = [
        link(named, "_v", "vendor", "_po", "source", "target"), link(rows.where("_gr is not null"), "_po", "predecessor", "_gr", "source", "target"), link(rows.where("_inv is not null"), "_po", "predecessor", "_inv", "source", "target"),
        link(rows.where("_inv is not null"), "_last", "goods_receipt", "_inv", "source", "target"),
    ]
    events = rows.select(F.col("_e").alias("event_id"), F.col("activity").alias("event_type"), "ts", _attributes(resource=F.col("resource")).alias("attributes"))
    return Log(reduce(DataFrame.unionByName, objects), events, reduce(DataFrame.unionByName, e2o), reduce(DataFrame.unionByName, o2o))


def ocel_from_flow(orders: DataFrame, items: DataFrame, deliveries: DataFrame, delivery_items: DataFrame, invoices: DataFrame, since: str | None = None, until: str | None = None, org: str | None = None, with_items: bool = True) -> Log:
    """Sales documents in the compact form: orders, deliveries and invoices and, on wish, their items, with links of items
    to their document and of delivered to ordered items. Orders may be chosen by date and organisation."""
    kept = orders.where(F.col("erdat") >= F.lit(since).cast("date")) if since else orders
    kept = kept.where(F.col("erdat") <= F.lit(until).cast("date")) if until else kept
    kept = kept.where(F.col("vkorg") == org) if org else kept
    name = lambda kind, *keys: F.concat_ws(":", F.lit(kind), *keys)
    head = kept.select("vbeln", "erdat", F.col("kunnr").alias("_k"), F.col("vkorg").alias("_o"), F.col("auart").alias("_a"), F.col("netwr").alias("_n"))
    shipped = deliveries.select("vbeln", "delivery", "created", "actual_gi").join(head, "vbeln")
    billed = invoices.select("invoice", "delivery", "billing_date").join(shipped.select("vbeln", "delivery", "_k", "_o"), "delivery")
    order, delivery, invoice = name("order", "vbeln"), name("delivery", "delivery"), name("invoice", "invoice")
    # frame, object, its type, attributes, event, its day, other objects of the event with their qualifiers, relations of the object
    made = [
        (head, order, "order", _attributes(order_type=F.col("_a"), sales_org=F.col("_o"), customer=F.col("_k"), net_value=F.col("_n")), "order_created", "erdat", [(order, "order")], []),
        (shipped, delivery, "delivery", _attributes(customer=F.col("_k")), "delivery_created", "created", [(order, "order"), (delivery, "delivery")], [(order, "source_order")]),
        (shipped.where("actual_gi is not null"), delivery, None, None, "goods_issued", "actual_gi", [(order, "order"), (delivery, "delivery")], []),
        (billed, invoice, "invoice", _attributes(sales_org=F.col("_o"), payer=F.col("_k")), "invoice_created", "billing_date", [(order, "order"), (invoice, "invoice")], [(order, "source_order")]),
    ]
    if with_items:
        lines = items.select("vbeln", "posnr", "matnr", "kwmeng", F.col("netwr").alias("_v")).join(head.select("vbeln", "erdat"), "vbeln")
        item, sent = name("order_item", "vbeln", "posnr"), name("delivery_item", "delivery", "posnr")
        parts = delivery_items.select("delivery", "posnr", "quantity", "ref_posnr").join(shipped.select("delivery", "vbeln", "created"), "delivery")
        made += [
            (lines, item, "order_item", _attributes(material=F.col("matnr"), quantity=F.col("kwmeng"), net_value=F.col("_v")), "item_added", "erdat", [(order, "order"), (item, "item")], [(order, "parent_order")]),
            (parts, sent, "delivery_item", _attributes(quantity=F.col("quantity")), "item_delivered", "created", [(delivery, "delivery"), (sent, "item")], [(delivery, "parent_delivery"), (name("order_item", "vbeln", "ref_posnr"), "source_item")]),
        ]
    objects, found, e2o, o2o = [], [], [], []
    for df, key, kind, attributes, event, day, related, relations in made:
        number = F.concat_ws("|", F.lit(event), key)
        if kind:
            objects.append(df.select(key.alias("object_id"), F.lit(kind).alias("object_type"), attributes.alias("attributes")))
        found.append(df.select(number.alias("event_id"), F.lit(event).alias("event_type"), F.to_timestamp(day).alias("ts"), F.create_map().cast("map<string,string>").alias("attributes")))
        e2o += [df.select(number.alias("event_id"), other.alias("object_id"), F.lit(q).alias("qualifier")) for other, q in related]
        o2o += [df.select(key.alias("source"), other.alias("target"), F.lit(q).alias("qualifier")) for other, q in relations]
    return Log(*(reduce(DataFrame.unionByName, x) for x in (objects, found, e2o, o2o)))


def write_ocel_json(object_table: DataFrame, event_table: DataFrame, relations: DataFrame, pairs: DataFrame, path: str) -> None:
    """One JSON line per object, per event (each with its relations), per object type and per event type, in four folders."""
    for table, name in ((object_table, "object_type"), (event_table, "event_type")):
        table.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/{name}s")
    o2o = relations.groupBy(F.col("source").alias("id")).agg(F.collect_list(F.struct(F.col("target").alias("objectId"), "qualifier")).alias("relationships"))
    e2o = pairs.groupBy(F.col("event_id").alias("id")).agg(F.collect_list(F.struct(F.col("object_id").alias("objectId"), "qualifier")).alias("relationships"))
    object_table.select(F.col("object_id").alias("id"), F.col("object_type").alias("type")).join(o2o, "id", "left").write.mode("overwrite").json(f"{path}/objects")
    event_table.select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("ts").alias("time")).join(e2o, "id", "left").write.mode("overwrite").json(f"{path}/events")


_LINKS = "array<struct<objectId: string, qualifier: string>>"
OBJECT_JSON = f"id string, type string, attributes map<string, string>, relationships {_LINKS}"
EVENT_JSON = f"id string, type string, time string, attributes map<string, string>, relationships {_LINKS}"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def type_definitions(table: DataFrame, kind: str) -> DataFrame:
    """name and attributes (name, type) of the types of objects or events, from the attributes that occur."""
    names = table.select(F.col(kind).alias("name"), F.explode_outer(F.map_keys("attributes")).alias("_a")).distinct()
    return names.groupBy("name").agg(F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct(F.col("_a").alias("name"), F.lit("string").alias("type"))))).alias("attributes"))


def document_lines(log: Log) -> DataFrame:
    """section, id, line: one JSON document with type definitions, objects and events, each with attributes and
    relations. In the order of section and id the lines are the document. A type is a row, and so is an object with all
    its relations, as the format has it."""
    none = F.array().cast(_LINKS)
    linked = lambda df, key, other: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(F.struct(F.col(other).alias("objectId"), "qualifier"))).alias("relationships"))
    objects = log.objects.dropDuplicates(["object_id"]).select(F.col("object_id").alias("id"), F.col("object_type").alias("type"), "attributes").join(linked(log.object_relations, "source", "target"), "id", "left")
    events = log.events.dropDuplicates(["event_id"]).select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.date_format("ts", TIME).alias("time"), "attributes").join(linked(log.event_objects, "event_id", "object_id"), "id", "left")

    def lines(df: DataFrame, section: int) -> DataFrame:
        columns = [F.coalesce("relationships", none).alias(c) if c == "relationships" else F.col(c) for c in df.columns]
        least = df.agg(F.min("id").alias("_least"))
        body = df.select("id", F.to_json(F.struct(*columns)).alias("_j")).crossJoin(F.broadcast(least))
        return body.select(F.lit(section).alias("section"), "id", F.when(F.col("id") == F.col("_least"), F.col("_j")).otherwise(F.concat(F.lit(","), "_j")).alias("line"))

    # the types are as few as kinds of objects and events
    types = [type_definitions(table, kind).agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", "attributes")))).alias(f"_{k}")) for k, (table, kind) in enumerate(((log.objects, "object_type"), (log.events, "event_type")))]
    head = types[0].crossJoin(types[1]).select(F.lit(0).alias("section"), F.lit("").alias("id"), F.concat(F.lit('{"objectTypes":'), "_0", F.lit(',"eventTypes":'), "_1", F.lit(',"objects":[')).alias("line"))
    between = log.objects.sparkSession.createDataFrame([(2, "", '],"events":['), (4, "", "]}")], "section int, id string, line string")
    return reduce(DataFrame.unionByName, [head, lines(objects, 1), between, lines(events, 3)])


def write_ocel_document(log: Log, path: str) -> None:
    """The document as text files that, one after another by name, are one JSON document; a small one is a single file."""
    ordered = document_lines(log).repartitionByRange("section", "id").sortWithinPartitions("section", "id")
    ordered.select("line").write.mode("overwrite").text(path)


def parsed_lines(lines: DataFrame) -> Log:
    """The log of a document's lines (column line)."""
    bare = lines.select(F.regexp_replace("line", r"^,", "").alias("j")).where("j like '{\"id\":%'")
    split = bare.withColumn("_o", F.get_json_object("j", "$.time").isNull())
    objects = split.where("_o").select(F.from_json("j", OBJECT_JSON).alias("x")).select("x.*")
    events = split.where("not _o").select(F.from_json("j", EVENT_JSON).alias("x")).select("x.*")
    link = lambda df, a, b: df.select(F.col("id").alias(a), F.explode("relationships").alias("r")).select(a, F.col("r.objectId").alias(b), "r.qualifier")
    return Log(
        objects.select(F.col("id").alias("object_id"), F.col("type").alias("object_type"), "attributes"), events.select(F.col("id").alias("event_id"), F.col("type").alias("event_type"), F.to_timestamp("time", TIME).alias("ts"), "attributes"),
        link(events, "event_id", "object_id"), link(objects, "source", "target"),
    )


def read_ocel_document(spark: SparkSession, path: str) -> Log:
    return parsed_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def process_map_lines(edges: DataFrame, form: str = "mermaid") -> DataFrame:
    """position, line of a diagram of aggregated edges (from_activity, to_activity, n), most frequent first."""
    ident = lambda c: F.regexp_replace(c, r"\W", "_")
    a, b, n = F.col("from_activity"), F.col("to_activity"), F.col("n").cast("string")
    if form == "mermaid":
        head, tail = "graph TD", ""
        line = F.concat(F.lit("    "), ident(a), F.lit(" -->|"), n, F.lit("| "), ident(b))
    else:
        head, tail = "digraph process {", "}"
        line = F.concat(F.lit('    "'), a, F.lit('" -> "'), b, F.lit('" [label="'), n, F.lit('"];'))
    body = edges.select((F.row_number().over(Window.orderBy(F.desc("n"), "from_activity", "to_activity"))).alias("position"), line.alias("line"))  # over the few aggregated edges
    spark = edges.sparkSession
    ends = [(0, head)] + ([(1 << 30, tail)] if tail else [])
    return body.unionByName(spark.createDataFrame(ends, "position int, line string"))
