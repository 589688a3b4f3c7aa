"""Process tables derived from the star schema, in Spark and as DuckDB text under the same names.

Every derivation is arithmetic on keys, so both engines give the same rows. SQL_VIEWS holds the text of each
table in an order in which later ones may use earlier ones; with_views() puts the needed ones before a query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF, LOG_AS_OF = "2001-12-31", "2024-01-31"


class Tables:
    """The derived tables over one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def event_log(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").cast("string").alias("case_id"), "event_id", F.col("event_type").alias("activity"), "ts",
            F.concat(F.lit("R"), (F.col("event_id") % 7).cast("string")).alias("resource"), "value",
        )

    def lines(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
        return self.read("lineitem").withColumn("line_no", F.row_number().over(order))

    def orders(self) -> DataFrame:
        joined = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        kinds = F.array(F.lit("OR"), F.lit("SO"), F.lit("RE"))
        return joined.select(
            F.col("o_orderkey").alias("orderkey"), key10("o_orderkey").alias("vbeln"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("vkorg"),
            key10("o_custkey").alias("kunnr"), kinds[(F.col("o_orderkey") % 3).cast("int")].alias("auart"), F.to_date("o_orderdate").alias("erdat"),
            F.date_add(F.to_date("o_orderdate"), 7).alias("vdatu"), F.col("o_totalprice").cast("decimal(18,2)").alias("netwr"), F.col("c_mktsegment").alias("industry"),
        )

    def items(self) -> DataFrame:
        return self.lines().select(
            key10("l_orderkey").alias("vbeln"), F.lpad((F.col("line_no") * 10).cast("string"), 6, "0").alias("posnr"), F.col("l_partkey").alias("matnr"),
            (F.col("l_suppkey") % 5).alias("werks"), F.col("l_quantity").alias("kwmeng"), F.col("l_extendedprice").cast("decimal(18,2)").alias("netwr"),
        )

    def deliveries(self) -> DataFrame:
        number = F.concat(F.lit("8"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.when(F.col("l_linestatus") == "F", "1").otherwise("0"))
        grouped = self.read("lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.to_date(F.min("l_shipdate")).alias("created"), F.to_date(F.max("l_shipdate")).alias("last"))
        return grouped.select(
            F.col("l_orderkey").alias("orderkey"), number.alias("delivery"), key10("l_orderkey").alias("vbeln"), "created",
            F.when(F.col("l_linestatus") != "O", F.col("last")).alias("actual_gi"), F.col("l_linestatus").alias("status"),
        )

    def invoices(self) -> DataFrame:
        done = self.deliveries().where("status = 'F'")
        return done.select("orderkey", F.concat(F.lit("9"), F.substring("delivery", 2, 10)).alias("invoice"), "delivery", F.date_add("actual_gi", (F.col("orderkey") % 5).cast("int")).alias("billing_date"), F.date_add("actual_gi", (F.col("orderkey") % 5 + F.col("orderkey") % 2).cast("int")).alias("posting_date"))

    def delivery_items(self) -> DataFrame:
        number = F.concat(F.lit("8"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.when(F.col("l_linestatus") == "F", "1").otherwise("0"))
        posnr = F.lpad((F.col("line_no") * 10).cast("string"), 6, "0")
        return self.lines().select(number.alias("delivery"), posnr.alias("posnr"), F.col("l_quantity").cast("long").alias("quantity"), posnr.alias("ref_posnr"))

    def doc_flow(self) -> DataFrame:
        first = self.deliveries().select(F.col("vbeln").alias("vbelv"), F.lit("C").alias("vbtyp_v"), F.col("delivery").alias("vbeln"), F.lit("J").alias("vbtyp_n"), F.col("created").alias("erdat"))
        second = self.invoices().select(F.col("delivery").alias("vbelv"), F.lit("J").alias("vbtyp_v"), F.col("invoice").alias("vbeln"), F.lit("M").alias("vbtyp_n"), F.col("billing_date").alias("erdat"))
        return first.unionByName(second)

    def o2c_log(self) -> DataFrame:
        """Orders and lines are read and dealt once each, whatever the number of events of an order or a delivery."""
        key = F.col("orderkey")
        event = lambda step, name, day: F.struct(F.lit(step).alias("step"), F.lit(name).alias("activity"), F.to_timestamp(day).alias("ts"))
        of_order = [
            event(1, "OrderCreated", F.col("erdat")),
            F.when(key % 11 == 0, event(2, "CreditBlock", F.col("erdat"))),
            F.when(key % 22 == 0, event(3, "CreditRelease", F.date_add("erdat", 1))),
        ]
        of_delivery = [
            event(4, "DeliveryCreated", F.col("created")),
            F.when(F.col("actual_gi").isNotNull(), event(5, "GoodsIssued", F.col("actual_gi"))),
            F.when(F.col("status") == "F", event(6, "InvoiceCreated", F.date_add("actual_gi", (key % 5).cast("int")))),
        ]
        events = lambda df, parts: df.select(F.col("vbeln").alias("case_id"), F.explode(F.array_compact(F.array(*parts))).alias("e")).select("case_id", "e.*")
        return numbered(events(self.orders(), of_order).unionByName(events(self.deliveries(), of_delivery)))

    def o2c_clean_log(self) -> DataFrame:
        key, steps = F.col("orderkey"), ["OrderCreated", "DeliveryCreated", "GoodsIssued", "InvoiceCreated"]
        swapped = key % 17 == 0
        day = lambda n: F.timestamp_add("DAY", n, F.to_timestamp("erdat"))
        orders = self.orders()
        rows = [
            (1, steps[0], day(F.lit(0)), key % 23 != 0),
            (2, steps[1], day(F.lit(2)), F.lit(True)),
            (3, steps[1], day(F.lit(3)), key % 19 == 0),
            (4, steps[2], day(F.when(swapped, 6).otherwise(4)), key % 13 != 0),
            (5, steps[3], day(F.when(swapped, 4).otherwise(6)), F.lit(True)),
        ]
        wide = orders.select("vbeln", F.explode(F.array_compact(F.array(*(F.when(keep, F.struct(F.lit(n).alias("step"), F.lit(name).alias("activity"), ts.alias("ts"))) for n, name, ts, keep in rows)))).alias("e"))
        return numbered(wide.select(F.col("vbeln").alias("case_id"), "e.*"))

    def bkpf(self) -> DataFrame:
        joined = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        codes = F.array(*(F.lit(c) for c in TCODES))
        user = F.concat(F.lit("U"), (F.col("o_custkey") % 25).cast("string"))
        return joined.select(
            F.lpad((F.col("c_nationkey") % 4).cast("string"), 4, "0").alias("BUKRS"), key10("o_orderkey").alias("BELNR"), F.year(day).cast("string").alias("GJAHR"),
            F.lpad(F.month(day).cast("string"), 3, "0").alias("MONAT"), day.alias("BUDAT"), F.date_add(day, (key % 120).cast("int")).alias("CPUDT"),
            F.concat(F.lpad((key % 24).cast("string"), 2, "0"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit("00")).alias("CPUTM"),
            user.alias("USNAM"), codes[(key % len(TCODES)).cast("int")].alias("TCODE"), F.when(key % 29 == 0, user).alias("PPNAM"),
            F.when(key % 31 == 0, F.lpad((key + 1).cast("string"), 10, "0")).alias("STBLG"), F.when(key % 31 == 0, F.year(day).cast("string")).alias("STJAH"),
            F.lit("USD").alias("WAERS"), F.when(key % 4 == 0, "VBRK").when(key % 4 == 1, "RMRP").alias("AWTYP"), F.when(key % 4 < 2, key10("o_orderkey")).alias("AWKEY"),
        )

    def bseg(self) -> DataFrame:
        head = self.bkpf().select("BUKRS", "BELNR", "GJAHR")
        part, supplier = F.col("l_partkey"), F.col("l_suppkey")
        amount = F.col("l_extendedprice").cast("decimal(18,2)")
        lines = self.lines().select(
            key10("l_orderkey").alias("_doc"), F.lpad(F.col("line_no").cast("string"), 3, "0").alias("BUZEI"),
            F.concat(F.when(part % 97 == 0, "1990").otherwise("4000"), F.lpad((part % 50).cast("string"), 2, "0")).alias("HKONT"),
            F.when(F.col("line_no") % 2 == 1, "S").otherwise("H").alias("SHKZG"),
            F.when(part % 20 == 0, (F.round(amount / 1000) * 1000).cast("decimal(18,2)")).otherwise(amount).alias("WRBTR"),
            F.array(F.lit("S"), F.lit("D"), F.lit("K"), F.lit("A"))[(supplier % 4).cast("int")].alias("KOART"),
            F.when(part % 200 == 0, "99").when(part % 2 == 0, "40").otherwise("50").alias("BSCHL"),
            F.when(supplier % 10 == 0, F.lpad((supplier % 4).cast("string"), 4, "0")).alias("VBUND"),
            F.to_date("l_shipdate").alias("ZFBDT"), F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("AUGDT"),
        )
        return head.join(lines, F.col("BELNR") == F.col("_doc")).drop("_doc")

    def texts(self) -> DataFrame:
        """Texts of orders: headers, items and deliveries in turn."""
        level = F.array(F.lit("header"), F.lit("item"), F.lit("delivery"))[(F.col("doc_id") % 3).cast("int")]
        orders = self.orders().select("orderkey", F.col("vbeln").alias("doc_key"), F.col("erdat").alias("changed"), "vkorg")
        return self.read("documents").join(orders, F.col("doc_id") == F.col("orderkey")).select("doc_key", level.alias("level"), F.when(F.col("doc_id") % 3 == 1, "000010").alias("posnr"), "lang", "text", "changed", "vkorg")

    def purchase_log(self) -> DataFrame:
        """The event log in the words of purchasing: activities dealt by event."""
        names = F.array(*map(F.lit, PURCHASE))
        return self.event_log().select("case_id", "event_id", names[(F.col("event_id") * 7 % len(PURCHASE)).cast("int")].alias("activity"), "ts", "resource", F.concat(F.lit("V"), (F.col("case_id").cast("long") % 5).cast("string")).alias("vendor"))

    def ska1(self) -> DataFrame:
        number = F.substring("HKONT", 5, 2).cast("int")
        return self.bseg().select("HKONT").distinct().select(F.col("HKONT").alias("SAKNR"), F.when(number % 2 == 0, "X").otherwise("").alias("XBILK"), F.concat(F.lit("Master "), F.col("HKONT")).alias("TXT50"))

    def skat(self) -> DataFrame:
        number = F.substring("HKONT", 5, 2).cast("int")
        return self.bseg().select("HKONT").distinct().where(number % 5 != 0).select(F.col("HKONT").alias("SAKNR"), F.lit("E").alias("SPRAS"), F.concat(F.lit("Account "), F.col("HKONT")).alias("TXT50"))


def key10(column: str):
    return F.lpad(F.col(column).cast("string"), 10, "0")


def numbered(log: DataFrame) -> DataFrame:
    """Ties in time keep the order of the steps; repeats of a step in a case at one time are the same event twice."""
    return log.withColumn("event_id", F.col("step").cast("long")).drop("step")


#: Transaction codes dealt to documents by key.
TCODES = ["FB01", "FBV1", "FBV2", "F110", "XK02", "FB08", "FB60", "FV50", "XK01", "VA01", "MIRO", "F-53"]

#: Activities of purchasing that are dealt to events.
PURCHASE = ["Create Purchase Requisition Item", "Create Purchase Order Item", "Change Quantity", "Record Goods Receipt", "Record Invoice Receipt", "Clear Invoice", "Vendor creates invoice", "SRM: Awaiting Approval", "Cancel Invoice Receipt", "Change Price", "Remove Payment Block"]

_CODES = "[" + ", ".join(f"'{c}'" for c in TCODES) + "]"
_HEAD = "FROM orders JOIN customer ON o_custkey = c_custkey"
SQL_VIEWS = {
    "fx_event_log": "SELECT CAST(user_id AS VARCHAR) AS case_id, event_id, event_type AS activity, ts, 'R' || CAST(event_id % 7 AS VARCHAR) AS resource, value FROM events",
    "fx_lines": "SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS line_no FROM lineitem",
    "fx_orders": f"""SELECT o_orderkey AS orderkey, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS vbeln, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS vkorg,
        lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS kunnr, ['OR', 'SO', 'RE'][CAST(o_orderkey % 3 AS INT) + 1] AS auart, CAST(o_orderdate AS DATE) AS erdat,
        CAST(o_orderdate AS DATE) + 7 AS vdatu, CAST(o_totalprice AS DECIMAL(18,2)) AS netwr, c_mktsegment AS industry {_HEAD}""",
    "fx_items": "SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS vbeln, lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') AS posnr, l_partkey AS matnr, l_suppkey % 5 AS werks, l_quantity AS kwmeng, CAST(l_extendedprice AS DECIMAL(18,2)) AS netwr FROM fx_lines",
    "fx_deliveries": """SELECT l_orderkey AS orderkey, '8' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS delivery,
        lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS vbeln, CAST(min(l_shipdate) AS DATE) AS created, CASE WHEN l_linestatus <> 'O' THEN CAST(max(l_shipdate) AS DATE) END AS actual_gi,
        l_linestatus AS status FROM lineitem GROUP BY l_orderkey, l_linestatus""",
    "fx_invoices": "SELECT orderkey, '9' || substr(delivery, 2, 10) AS invoice, delivery, actual_gi + CAST(orderkey % 5 AS INT) AS billing_date, actual_gi + CAST(orderkey % 5 + orderkey % 2 AS INT) AS posting_date FROM fx_deliveries WHERE status = 'F'",
    "fx_delivery_items": """SELECT '8' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || CASE WHEN l_linestatus = 'F' THEN '1' ELSE '0' END AS delivery, lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') AS posnr,
        CAST(l_quantity AS BIGINT) AS quantity, lpad(CAST(line_no * 10 AS VARCHAR), 6, '0') AS ref_posnr FROM fx_lines""",
    "fx_doc_flow": "SELECT vbeln AS vbelv, 'C' AS vbtyp_v, delivery AS vbeln, 'J' AS vbtyp_n, created AS erdat FROM fx_deliveries UNION ALL SELECT delivery, 'J', invoice, 'M', billing_date FROM fx_invoices",
    "fx_o2c_log": """SELECT vbeln AS case_id, 'OrderCreated' AS activity, CAST(erdat AS TIMESTAMP) AS ts, CAST(1 AS BIGINT) AS event_id FROM fx_orders
        UNION ALL SELECT vbeln, 'DeliveryCreated', CAST(created AS TIMESTAMP), 4 FROM fx_deliveries
        UNION ALL SELECT vbeln, 'GoodsIssued', CAST(actual_gi AS TIMESTAMP), 5 FROM fx_deliveries WHERE actual_gi IS NOT NULL
        UNION ALL SELECT lpad(CAST(orderkey AS VARCHAR), 10, '0'), 'InvoiceCreated', CAST(billing_date AS TIMESTAMP), 6 FROM fx_invoices
        UNION ALL SELECT vbeln, 'CreditBlock', CAST(erdat AS TIMESTAMP), 2 FROM fx_orders WHERE orderkey % 11 = 0
        UNION ALL SELECT vbeln, 'CreditRelease', CAST(erdat + 1 AS TIMESTAMP), 3 FROM fx_orders WHERE orderkey % 22 = 0""",
    "fx_o2c_clean_log": """SELECT vbeln AS case_id, 'OrderCreated' AS activity, CAST(erdat AS TIMESTAMP) AS ts, CAST(1 AS BIGINT) AS event_id FROM fx_orders WHERE orderkey % 23 <> 0
        UNION ALL SELECT vbeln, 'DeliveryCreated', CAST(erdat + 2 AS TIMESTAMP), 2 FROM fx_orders
        UNION ALL SELECT vbeln, 'DeliveryCreated', CAST(erdat + 3 AS TIMESTAMP), 3 FROM fx_orders WHERE orderkey % 19 = 0
        UNION ALL SELECT vbeln, 'GoodsIssued', CAST(erdat + CASE WHEN orderkey % 17 = 0 THEN 6 ELSE 4 END AS TIMESTAMP), 4 FROM fx_orders WHERE orderkey % 13 <> 0
        UNION ALL SELECT vbeln, 'InvoiceCreated', CAST(erdat + CASE WHEN orderkey % 17 = 0 THEN 4 ELSE 6 END AS TIMESTAMP), 5 FROM fx_orders""",
    "fx_bkpf": f"""SELECT lpad(CAST(c_nationkey % 4 AS VARCHAR), 4, '0') AS BUKRS, lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS BELNR, CAST(year(o_orderdate) AS VARCHAR) AS GJAHR,
        lpad(CAST(month(o_orderdate) AS VARCHAR), 3, '0') AS MONAT, CAST(o_orderdate AS DATE) AS BUDAT, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) AS CPUDT,
        lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '00' AS CPUTM, 'U' || CAST(o_custkey % 25 AS VARCHAR) AS USNAM,
        {_CODES}[CAST(o_orderkey % {len(TCODES)} AS INT) + 1] AS TCODE, CASE WHEN o_orderkey % 29 = 0 THEN 'U' || CAST(o_custkey % 25 AS VARCHAR) END AS PPNAM,
        CASE WHEN o_orderkey % 31 = 0 THEN lpad(CAST(o_orderkey + 1 AS VARCHAR), 10, '0') END AS STBLG, CASE WHEN o_orderkey % 31 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) END AS STJAH,
        'USD' AS WAERS, CASE o_orderkey % 4 WHEN 0 THEN 'VBRK' WHEN 1 THEN 'RMRP' END AS AWTYP, CASE WHEN o_orderkey % 4 < 2 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') END AS AWKEY {_HEAD}""",
    "fx_bseg": """SELECT b.BUKRS, b.BELNR, b.GJAHR, lpad(CAST(line_no AS VARCHAR), 3, '0') AS BUZEI,
        CASE WHEN l_partkey % 97 = 0 THEN '1990' ELSE '4000' END || lpad(CAST(l_partkey % 50 AS VARCHAR), 2, '0') AS HKONT, CASE WHEN line_no % 2 = 1 THEN 'S' ELSE 'H' END AS SHKZG,
        CASE WHEN l_partkey % 20 = 0 THEN CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) / 1000) * 1000 AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS WRBTR,
        ['S', 'D', 'K', 'A'][CAST(l_suppkey % 4 AS INT) + 1] AS KOART, CASE WHEN l_partkey % 200 = 0 THEN '99' WHEN l_partkey % 2 = 0 THEN '40' ELSE '50' END AS BSCHL,
        CASE WHEN l_suppkey % 10 = 0 THEN lpad(CAST(l_suppkey % 4 AS VARCHAR), 4, '0') END AS VBUND, CAST(l_shipdate AS DATE) AS ZFBDT,
        CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS AUGDT FROM fx_bkpf b JOIN fx_lines ON b.BELNR = lpad(CAST(l_orderkey AS VARCHAR), 10, '0')""",
    "fx_ska1": "SELECT DISTINCT HKONT AS SAKNR, CASE WHEN CAST(substr(HKONT, 5, 2) AS INT) % 2 = 0 THEN 'X' ELSE '' END AS XBILK, 'Master ' || HKONT AS TXT50 FROM fx_bseg",
    "fx_texts": """SELECT vbeln AS doc_key, ['header', 'item', 'delivery'][CAST(doc_id % 3 AS INT) + 1] AS level, CASE WHEN doc_id % 3 = 1 THEN '000010' END AS posnr, lang, text, erdat AS changed, vkorg
        FROM documents JOIN fx_orders ON doc_id = orderkey""",
    "fx_purchase_log": f"SELECT case_id, event_id, [{', '.join(repr(a) for a in PURCHASE)}][CAST(event_id * 7 % {len(PURCHASE)} AS INT) + 1] AS activity, ts, resource, 'V' || CAST(CAST(case_id AS BIGINT) % 5 AS VARCHAR) AS vendor FROM fx_event_log",
    "fx_skat": "SELECT DISTINCT HKONT AS SAKNR, 'E' AS SPRAS, 'Account ' || HKONT AS TXT50 FROM fx_bseg WHERE CAST(substr(HKONT, 5, 2) AS INT) % 5 <> 0",
}


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """The query with the views it uses, directly or through others, as common table expressions."""
    views = SQL_VIEWS | (extra or {})
    needed: set[str] = set()

    def need(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                need(views[name])

    need(sql)
    heads = ", ".join(f"{name} AS ({text})" for name, text in views.items() if name in needed)
    if not heads:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {sql.lstrip()[len('WITH RECURSIVE') :]}"
    return f"WITH {heads}, {sql.lstrip()[4:]}" if sql.lstrip().upper().startswith("WITH ") else f"WITH {heads} {sql}"
