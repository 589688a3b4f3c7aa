"""Exports as canonical tables: files found by their accepted names, CSV exports of sales documents, rows of remote
services and of external order collections.

Only names of files come to the driver; rows stay in DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import pad_document, parse_sap_date, parse_sap_time
from .readers import PLACE, read_csv

#: Accepted names of the files of each set of records and of each exported table, in order of preference.
ENTITY_FILES = {
    "sales_orders": ["sales_orders.json", "orders.json"], "deliveries": ["deliveries.json", "delivery.json"], "invoices": ["invoices.json", "invoice.json", "billing.json"],
    "doc_flow": ["doc_flow.json", "doc_flows.json", "document_flow.json", "flow.json"], "customers": ["customers.json", "customer.json"], "materials": ["materials.json", "material.json"],
}
TABLE_FILES = {
    "VBAK": ["VBAK.csv", "vbak.csv", "VBAK.CSV", "sales_orders.csv"], "VBAP": ["VBAP.csv", "vbap.csv", "VBAP.CSV", "sales_order_items.csv"],
    "TEXT": ["STXH.csv", "stxh.csv", "STXL.csv", "stxl.csv", "texts.csv", "TEXTS.csv"], "VBFA": ["VBFA.csv", "vbfa.csv", "VBFA.CSV", "doc_flow.csv"],
}
REQUIRED = ("VBAK", "VBAP")
#: Accepted headers of exported columns.
SD_ALIASES = {
    "vbeln": ["vbeln", "VBELN", "sales_document", "Sales Document", "order_number", "Order Number"], "posnr": ["posnr", "POSNR", "item_number", "Item Number", "Item"], "auart": ["auart", "AUART", "order_type", "Order Type", "Sales Document Type"],
    "vkorg": ["vkorg", "VKORG", "sales_org", "Sales Org", "Sales Organization"], "vtweg": ["vtweg", "VTWEG", "Distribution Channel"], "spart": ["spart", "SPART", "Division"], "erdat": ["erdat", "ERDAT", "created_date", "Created Date", "Creation Date"],
    "netwr": ["netwr", "NETWR", "net_value", "Net Value"], "kunnr": ["kunnr", "KUNNR", "customer", "Customer", "Sold-to Party"], "matnr": ["matnr", "MATNR", "material", "Material"], "kwmeng": ["kwmeng", "KWMENG", "quantity", "Order Quantity"],
    "werks": ["werks", "WERKS", "plant", "Plant"], "tdname": ["tdname", "TDNAME", "text_name"], "tdline": ["tdline", "TDLINE", "text", "text_line"], "vbelv": ["vbelv", "VBELV", "preceding_document"], "vbtyp_n": ["vbtyp_n", "VBTYP_N", "subsequent_category"],
    "vbtyp_v": ["vbtyp_v", "VBTYP_V", "preceding_category"],
}
SD_NUMBERS = ("netwr", "kwmeng")


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder of any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(status.getPath().getName() for status in system.listStatus(path))


def find_files(spark: SparkSession, folder: str, names: dict[str, list[str]]) -> dict[str, str]:
    """The path of the first accepted name of each kind that the folder has."""
    have = set(file_names(spark, folder))
    return {kind: f"{folder}/{next(n for n in accepted if n in have)}" for kind, accepted in names.items() if have & set(accepted)}


def find_table_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of the exported tables; the two that everything hangs on must be there."""
    found = find_files(spark, folder, TABLE_FILES)
    missing = [t for t in REQUIRED if t not in found]
    if missing:
        raise FileNotFoundError(f"no file of {', '.join(missing)} in {folder}")
    return found


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: a list, or an object whose only array of objects is the list."""
    read = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in read.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    others = [f for f in read.schema.fields if f.name not in lists and not isinstance(f.dataType, T.StructType)]
    return read.select(F.explode(lists[0]).alias("_r")).select("_r.*") if len(lists) == 1 and not others else read


def read_entities(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sets of records that the folder has, by kind."""
    return {kind: read_records(spark, path) for kind, path in find_files(spark, folder, ENTITY_FILES).items()}


def number(text: Column) -> Column:
    """A double of a text with a decimal comma or with commas between thousands; None for other text."""
    t = F.trim(text)
    plain = F.when(t.contains(",") & ~t.contains("."), F.replace(t, F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def encoding_of(spark: SparkSession, path: str) -> str:
    """UTF-8, or ISO-8859-1 if the file has bytes that UTF-8 doesn't."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def read_sd_table(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """An exported table with canonical columns: keys as text, amounts as numbers, dates as dates."""
    table = read_csv(spark, path, encoding_of(spark, path), SD_ALIASES, placed)
    kept = [c for c in (*SD_ALIASES, *(PLACE if placed else ())) if c in table.columns]
    typed = {c: number(F.col(c)) for c in SD_NUMBERS if c in kept}
    if "erdat" in kept:
        typed["erdat"] = F.try_to_timestamp(parse_sap_date(F.col("erdat")), F.lit("yyyyMMdd")).cast("date")
    return table.select(*kept).withColumns(typed) if typed else table.select(*kept)


def read_sd_csv(spark: SparkSession, folder: str) -> DataFrame:
    """One row an order: header columns, items, flow edges and the joined text of a folder of exports. Texts belong to the
    order whose number their name starts with, their lines in the order of the file."""
    paths = find_table_files(spark, folder)
    tables = {kind: read_sd_table(spark, path, placed=kind == "TEXT") for kind, path in paths.items()}
    nothing = spark.createDataFrame([], "vbeln string")
    items = tables["VBAP"].where("vbeln is not null")
    lines = items.groupBy("vbeln").agg(F.array_sort(F.collect_list(F.struct(*(c for c in ("posnr", "matnr", "kwmeng", "netwr", "werks") if c in items.columns)))).alias("items"))
    texts, flow = nothing.withColumn("text", F.lit("")), nothing.withColumn("flow", F.array().cast("array<string>"))
    if "TEXT" in tables:
        named = tables["TEXT"].withColumn("vbeln", F.substring(pad_document(F.col("tdname"), 10), 1, 10)) if "tdname" in tables["TEXT"].columns else tables["TEXT"]
        texts = named.where("tdline is not null").groupBy("vbeln").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_file", "_start", "_at", "tdline")))["tdline"], " ").alias("text"))
    if "VBFA" in tables:
        flow = tables["VBFA"].where("vbelv is not null").groupBy(F.col("vbelv").alias("vbeln")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "vbtyp_n", "vbeln"))).alias("flow"))
    orders = tables["VBAK"].where("vbeln is not null").join(lines, "vbeln", "left").join(texts, "vbeln", "left").join(flow, "vbeln", "left")
    return orders.withColumn("text", F.coalesce("text", F.lit("")))


#: Names that remote services give to columns, by kind of row; dates and times are parsed.
SERVICE = {
    "header": {"VBELN": "vbeln", "AUART": "auart", "VKORG": "vkorg", "VTWEG": "vtweg", "SPART": "spart", "KUNNR": "kunnr", "AUDAT": "erdat", "ERNAM": "ernam", "ERDAT": "erdat", "ERZET": "erzet", "NETWR": "netwr", "WAERK": "waerk", "KUNWE": "kunwe", "VDATU": "vdatu", "AEDAT": "aedat", "BSTNK": "bstnk", "BSTKD": "bstdk"},
    "item": {"VBELN": "vbeln", "POSNR": "posnr", "MATNR": "matnr", "WERKS": "werks", "KWMENG": "kwmeng", "VRKME": "vrkme", "NETWR": "netwr", "WAERK": "waerk", "PSTYV": "pstyv", "ARKTX": "arktx", "LGORT": "lgort", "ABGRU": "abgru"},
    "delivery": {"VBELN": "vbeln", "LFART": "lfart", "KUNNR": "kunnr", "BTGEW": "btgew", "GEWEI": "gewei", "ERDAT": "erdat", "ERZET": "erzet", "ROUTE": "route", "WADAT": "wadat", "WADAT_IST": "podat", "LFDAT": "lfdat", "LDDAT": "lddat"},
    "invoice": {"VBELN": "vbeln", "FKART": "fkart", "FKDAT": "fkdat", "KUNRG": "kunrg", "NETWR": "netwr", "WAERK": "waerk", "ERDAT": "erdat", "ERZET": "erzet", "KUNAG": "kunag"},
    "flow": {"VBELV": "vbelv", "POSNV": "posnv", "VBTYP_V": "vbtyp_v", "VBELN": "vbeln", "POSNN": "posnn", "VBTYP_N": "vbtyp_n", "RFMNG": "rfmng", "ERDAT": "erdat"},
}
DATES, TIMES = {"AUDAT", "ERDAT", "VDATU", "AEDAT", "WADAT", "WADAT_IST", "LFDAT", "LDDAT", "FKDAT"}, {"ERZET"}


def map_service_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a remote service, landed as a table, under their canonical names; columns that are absent stay out."""

    def value(name: str, source: str) -> Column:
        c = F.col(source)
        return parse_sap_date(c.cast("string")) if name in DATES else parse_sap_time(c.cast("string")) if name in TIMES else c

    return rows.select(*(value(name, source).alias(name) for name, source in SERVICE[kind].items() if source in rows.columns))


#: Names in external order collections.
EXTERNAL_HEADER = {"auart": "SalesDocumentType", "vkorg": "SalesOrganization", "vtweg": "DistributionChannel", "spart": "Division", "kunnr": "SoldToParty", "erdat": "CreationDate", "vdatu": "RequestedDeliveryDate", "netwr": "TotalNetAmount", "waerk": "TransactionCurrency"}
EXTERNAL_ITEM = {"matnr": "Material", "werks": "Plant", "kwmeng": "OrderQuantity", "netwr": "NetAmount", "pstyv": "ItemCategory"}


def map_external_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """External order headers with their items, under canonical names: numbers of ten and six digits, items in order."""
    own = [(name, source) for name, source in EXTERNAL_ITEM.items() if source in items.columns]
    lines = items.select(F.lpad(F.col("SalesDocument").cast("string"), 10, "0").alias("vbeln"), F.struct(F.lpad(F.col("SalesDocumentItem").cast("string"), 6, "0").alias("posnr"), *(F.col(source).alias(name) for name, source in own)).alias("_i"))
    grouped = lines.groupBy("vbeln").agg(F.array_sort(F.collect_list("_i")).alias("items"))
    heads = orders.select(F.lpad(F.col("SalesDocument").cast("string"), 10, "0").alias("vbeln"), *(F.col(source).alias(name) for name, source in EXTERNAL_HEADER.items() if source in orders.columns))
    return heads.join(grouped, "vbeln", "left")


def map_external_customers(customers: DataFrame, addresses: DataFrame) -> DataFrame:
    """Customers with the country and region of their address and a name without a person in it."""
    where = addresses.groupBy(F.col("Customer").cast("string").alias("kunnr")).agg(F.max_by("Country", F.coalesce("Region", F.lit(""))).alias("land1"), F.max(F.coalesce("Region", F.lit(""))).alias("regio"))
    key, has = F.col("Customer").cast("string"), customers.columns
    named = customers.select(
        key.alias("kunnr"), F.concat(F.lit("Customer "), F.right(key, F.lit(4))).alias("name1"), (F.coalesce("IndustryKey", F.lit("MISC")) if "IndustryKey" in has else F.lit("MISC")).alias("brsch"),
        (F.coalesce("SalesOrganization", F.lit("1000")) if "SalesOrganization" in has else F.lit("1000")).alias("vkorg"),
    )
    return named.join(where, "kunnr", "left").withColumns({"land1": F.coalesce("land1", F.lit("US")), "regio": F.coalesce("regio", F.lit("NA"))})
