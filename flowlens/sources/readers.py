"""Readers: documents in JSON, CSV exports, event logs and traces, into canonical columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import parse_sap_amount, parse_sap_date

#: Accepted names of canonical columns.
ALIASES = {
    "order_number": ["vbeln", "VBELN", "order_id", "sales_order", "order_number"], "order_date": ["erdat", "ERDAT", "created_date", "order_date"], "requested_date": ["vdatu", "VDATU", "requested_delivery_date"],
    "customer": ["kunnr", "KUNNR", "customer_id", "sold_to"], "sales_org": ["vkorg", "VKORG", "sales_organization"], "net_value": ["netwr", "NETWR", "amount", "value"], "currency": ["waerk", "WAERK", "currency"],
    "case_id": ["case concept:name", "case_id", "case:concept:name"], "activity": ["event concept:name", "activity", "concept:name"], "ts": ["event time:timestamp", "timestamp", "time:timestamp", "ts"], "resource": ["event org:resource", "resource", "org:resource", "User"],
}
#: The columns by which a ledger table is known.
FI_TABLES = {"BSEG": {"BUKRS", "BELNR", "GJAHR", "BUZEI"}, "BKPF": {"BUKRS", "BELNR", "GJAHR", "BUDAT"}, "SKAT": {"SPRAS", "SAKNR"}, "SKA1": {"KTOPL", "SAKNR"}, "CSKS": {"KOKRS", "KOSTL"}, "COEP": {"KOKRS", "KSTAR"}, "T001": {"BUKRS", "BUTXT"}}
FI_AMOUNTS, FI_DATES = {"WRBTR", "DMBTR", "WKGBTR"}, {"BUDAT", "BLDAT", "CPUDT", "AUGDT", "ZFBDT"}


def canonicalise(df: DataFrame, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """Canonical columns from the first alias that has a value; the originals stay."""
    made = {}
    for name, known in aliases.items():
        present = [c for c in known if c in df.columns]
        if present and name not in df.columns:
            made[name] = F.coalesce(*(F.col(f"`{c}`") for c in present))
    return df.withColumns(made)


def validate_schema(df: DataFrame, required: list[str]) -> DataFrame:
    """column, n_missing, n_rows, status (ok, warning, error) over all rows, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string") == "")).alias(c) if c in df.columns else F.count("*").alias(c) for c in required))
    rows = counts.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in required))).alias("r"))
    status = F.when(F.col("n_missing") == F.col("n_rows"), "error").when(F.col("n_missing") * 2 > F.col("n_rows"), "warning").otherwise("ok")
    return rows.select("r.*", F.col("_n").alias("n_rows")).withColumn("status", status)


def read_documents(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """Records of a JSON file: a list, lines, or an object that wraps the list."""
    read = spark.read.option("multiLine", wrapper is not None).json(path)
    return read.select(F.explode(wrapper).alias("_r")).select("_r.*") if wrapper else read


def delimiter(spark: SparkSession, path: str) -> str:
    """The most frequent of the usual separators in the first line of a file."""
    first = spark.read.text(path).limit(1).first()
    return max([",", ";", "\t", "|"], key=lambda d: first[0].count(d) if first else 0)


#: Where a row of a file stands: places within a split grow with it, and splits with their start in the file.
PLACE = {"_file": "_metadata.file_path", "_start": "_metadata.file_block_start", "_at": "monotonically_increasing_id()"}


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", aliases: dict[str, list[str]] = ALIASES, placed: bool = False) -> DataFrame:
    """A CSV export with all columns as text, null words as null, and canonical columns; on wish with each row's place."""
    raw = spark.read.option("header", True).option("sep", delimiter(spark, path)).option("encoding", encoding).csv(path)
    clean = raw.select(*(F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "null", "none", "nan", "n/a"), F.trim(F.col(f"`{c}`"))).alias(c.strip()) for c in raw.columns), *(F.expr(c).alias(n) for n, c in PLACE.items() if placed))
    return canonicalise(clean, aliases)


def csv_profile(df: DataFrame, aliases: dict[str, list[str]] = ALIASES, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """column, is_mapped, maps_to, status (mapped, unmapped, missing), expected, n_rows of a table: its columns, and the key
    fields that none of its columns is, with the names that would do."""
    known = {c: name for name, names in aliases.items() for c in (name, *names)}
    rows = [(c, c.strip() in known, known.get(c.strip()), "mapped" if c.strip() in known else "unmapped", None) for c in df.columns]
    have = {known.get(c.strip()) for c in df.columns}
    rows += [(key, False, None, "missing", ",".join(aliases.get(key, [])) or key) for key in keys if key not in have and key not in df.columns]
    names = df.sparkSession.createDataFrame(rows, "column string, is_mapped boolean, maps_to string, status string, expected string")
    return names.crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows"))))


#: Columns of parquet exports of sales documents, items and customers.
SALES_DOCUMENT_COLUMNS = {
    "SALESDOCUMENT": "document_number", "CREATIONDATE": "created_date", "SALESDOCUMENTTYPE": "order_type", "SALESORGANIZATION": "sales_org", "DISTRIBUTIONCHANNEL": "distribution_channel", "ORGANIZATIONDIVISION": "division",
    "SOLDTOPARTY": "customer", "SALESOFFICE": "sales_office", "SALESGROUP": "sales_group", "CUSTOMERPAYMENTTERMS": "payment_terms", "SHIPPINGCONDITION": "shipping_condition", "HEADERINCOTERMSCLASSIFICATION": "incoterms",
    "PRICINGDATE": "pricing_date", "REQUESTEDDELIVERYDATE": "requested_delivery_date",
}
SALES_ITEM_COLUMNS = {
    "SALESDOCUMENT": "document_number", "SALESDOCUMENTITEM": "item_number", "MATERIAL": "material_id", "PLANT": "plant", "SHIPPINGPOINT": "shipping_point", "REQUESTEDQUANTITY": "quantity", "NETAMOUNT": "net_value",
    "ITEMINCOTERMSCLASSIFICATION": "item_incoterms",
}
CUSTOMER_COLUMNS = {"CUSTOMER": "customer_id", "CUSTOMERNAME": "name", "CUSTOMERACCOUNTGROUP": "account_group", "COUNTRY": "country", "REGION": "region", "CITYNAME": "city", "POSTALCODE": "postal_code"}


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that have a name of ours, under it; columns are met in any case."""
    return df.select(*(F.col(f"`{c}`").alias(names[c.upper()]) for c in df.columns if c.upper() in names))


def sales_documents(headers: DataFrame, items: DataFrame, customers: DataFrame | None = None) -> DataFrame:
    """Orders of a parquet export with their items as a sorted array and, if given, the customer as a struct."""
    head, line = rename_columns(headers, SALES_DOCUMENT_COLUMNS), rename_columns(items, SALES_ITEM_COLUMNS)
    own = [c for c in line.columns if c != "document_number"]
    found = head.join(line.groupBy("document_number").agg(F.array_sort(F.collect_list(F.struct(*own))).alias("items")), "document_number", "left")
    if customers is None:
        return found
    known = rename_columns(customers, CUSTOMER_COLUMNS)
    return found.join(known.select(F.col("customer_id").alias("customer"), F.struct(*known.columns).alias("customer_master")), "customer", "left")


def detect_fi_table(columns: list[str]) -> str | None:
    have = {c.upper() for c in columns}
    return next((table for table, needed in FI_TABLES.items() if needed <= have), None)


def read_fi_lines(lines: DataFrame, header: list[str] | None = None) -> DataFrame:
    """A ledger export framed by pipes (column value): separator and empty rows dropped, dates and amounts parsed.
    The header is the first row with letters unless it is given."""
    rows = lines.where(~F.col("value").rlike(r"^[\s|+-]*$")).select(F.regexp_replace(F.trim("value"), r"^\|\|?|\|$", "").alias("value"))
    if header is None:
        header = [c.strip().strip('"') for c in rows.limit(1).first()[0].split("|")]
    cells = F.transform(F.split("value", r"\|"), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    data = rows.select(cells.alias("_c")).where(F.col("_c")[0] != header[0])
    typed = lambda c, i: parse_sap_amount(F.col("_c")[i]) if c in FI_AMOUNTS else F.try_to_timestamp(parse_sap_date(F.col("_c")[i]), F.lit("yyyyMMdd")).cast("date") if c in FI_DATES else F.when(F.col("_c")[i] != "", F.col("_c")[i])
    return data.select(*(typed(c, i).alias(c) for i, c in enumerate(header)))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and where a line stands: file, start of the split that it is read in, and place there. A large file is many
    splits, each cut at a line."""
    return spark.read.text(path).select("value", *(F.expr(c).alias(n) for n, c in PLACE.items()))


def carried(lines: DataFrame, mark: Column, to: str) -> DataFrame:
    """lines (of placed_lines) with the last mark at or before each; marks are null between. A split takes over the last
    one of the splits before it in its file, which is a row a split."""
    marked = lines.withColumn("_mark", mark)
    split = ["_file", "_start"]
    own = marked.withColumn("_own", F.last("_mark", ignorenulls=True).over(Window.partitionBy(*split).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    last = marked.groupBy(*split).agg(F.max_by(F.col("_mark"), F.when(F.col("_mark").isNotNull(), F.col("_at"))).alias("_end"))
    before = last.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    return own.join(before, split).withColumn(to, F.coalesce("_own", "_before")).drop("_mark", "_own", "_before")


def read_fi_combined(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a file whose sections are parted by empty lines, by name of the table that each header shows. Headers are
    few and read by the driver; a section may lie in many splits, whose lines find their header before them."""
    names = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\|+|\|+$", ""), r"\|"), lambda c: F.upper(F.trim(F.regexp_replace(c, '"', ""))))
    known = reduce(lambda out, x: out.when(F.size(F.array_intersect(names, F.array(*map(F.lit, sorted(x[1]))))) == len(x[1]), x[0]), FI_TABLES.items(), F.when(F.lit(False), ""))
    # an empty line ends a section, so that rows under a header of no known table belong to none
    mark = F.when(F.trim("value") == "", F.struct(F.lit("").alias("table"), F.lit("").alias("head"))).when(known.isNotNull(), F.struct(known.alias("table"), F.col("value").alias("head")))
    rows = carried(placed_lines(spark, path), mark, "_section").where("_section.table != '' and value != _section.head")
    heads = rows.select("_section.table", "_section.head").distinct().orderBy("table", "head").collect()
    found: dict[str, DataFrame] = {}
    for table, head in heads:
        header = [c.strip().strip('"') for c in head.strip().strip("|").split("|")]
        part = read_fi_lines(rows.where((F.col("_section.table") == table) & (F.col("_section.head") == head)).select("value"), header)
        found[table] = found[table].unionByName(part, allowMissingColumns=True) if table in found else part
    return found


#: Columns of purchase logs that say yes or no, and their canonical names.
FLAGS = {"is_gr_based": "case GR-Based Inv. Verif.", "is_goods_receipt": "case Goods Receipt"}


def read_event_log_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """case_id, activity, ts, resource, event_id and the flags that the file has. event_id numbers the events of a case in
    the order of files and of places in them, so ties in time keep that order however the files are split."""
    read = spark.read.option("header", True).option("sep", delimiter(spark, path)).option("encoding", encoding).csv(path)
    # positions within a split grow with it, and splits with their start in the file
    placed = read.withColumns({"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()})
    log = canonicalise(placed)
    ts = F.coalesce(F.try_to_timestamp("ts", F.lit("dd-MM-yyyy HH:mm:ss.SSS")), F.try_to_timestamp("ts"))
    within = Window.partitionBy("case_id").orderBy("_file", "_start", "_at")
    flags = [F.lower(F.col(f"`{source}`")).isin("true", "x", "1", "yes").alias(name) for name, source in FLAGS.items() if source in read.columns]
    return log.select("case_id", "activity", ts.alias("ts"), "resource" if "resource" in log.columns else F.lit(None).cast("string").alias("resource"), F.row_number().over(within).cast("long").alias("event_id"), *flags)


#: A trace of an export: its events are maps with an activity and a time.
TRACE = "case_id string, events array<struct<activity: string, timestamp: string>>"


def read_trace_json(spark: SparkSession, path: str, case_first: bool = True) -> DataFrame:
    """Nested traces to a flat log. Where the case is the first field of a trace, as exports write it, the file is cut at
    these fields and read in many splits; else (case_first=False) a file is read whole."""
    if case_first:
        cut = spark.read.option("lineSep", '"case_id"').text(path).where("ltrim(value) like ':%'")
        traces = cut.select(F.from_json(F.concat(F.lit('{"case_id"'), "value"), TRACE).alias("t")).where("t is not null")
    else:
        traces = spark.read.option("multiLine", True).schema("traces array<struct<case_id: string, events: array<struct<activity: string, timestamp: string>>>>").json(path).select(F.explode("traces").alias("t"))
    flat = traces.select("t.case_id", F.posexplode("t.events").alias("event_id", "e"))
    return flat.select("case_id", F.col("event_id").cast("long"), F.col("e.activity").alias("activity"), F.try_to_timestamp("e.timestamp").alias("ts"))


def join_text_lines(lines: DataFrame) -> DataFrame:
    """Text lines (TDNAME, TDID, TDSPRAS, line_no, TDLINE) to one text per object, id and language."""
    text = F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "TDLINE")))["TDLINE"], "\n")
    return lines.groupBy("TDNAME", "TDID", "TDSPRAS").agg(text.alias("text"))


def number_items(items: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Item numbers in steps of ten within each document."""
    return items.withColumn("posnr", F.lpad((F.row_number().over(Window.partitionBy(key).orderBy(*order)) * 10).cast("string"), 6, "0"))


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """Parquet tables of one shape, one after another."""
    return reduce(DataFrame.unionByName, (canonicalise(spark.read.parquet(f"{folder}/{n}.parquet")) for n in names))


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def card_lines(cards: DataFrame) -> DataFrame:
    """Cards as Markdown text, one row each."""
    quotes = F.array_join(F.transform(F.coalesce("snippets", F.array().cast("array<string>")), lambda x: F.concat(F.lit("> "), F.substring(x, 1, 200), F.lit("..."))), "\n")
    parts = [
        F.format_string("## %s", F.col("title")), F.format_string("- id: %s", "card_id"), F.format_string("- documents: %d (%.2f %%)", "n", "percent"), F.format_string("- confidence: %.2f, %s", "confidence", "category"), F.col("description"),
        F.concat(F.lit("- "), F.replace(F.col("caveats"), F.lit("|"), F.lit("\n- "))), F.when(quotes != "", quotes),
    ]
    return cards.select(F.concat_ws("\n", *parts).alias("value"))


def write_cards(cards: DataFrame, effects: DataFrame, evidence: DataFrame, path: str) -> None:
    """Cards, effects and evidence as JSON and the cards as Markdown, each in a folder of its own."""
    write_tables({"pattern_cards": cards, "correlation": effects, "evidence": evidence, "clustering": cards.select("cluster", "card_id", "n", "percent")}, path, "json")
    card_lines(cards).write.mode("overwrite").text(f"{path}/pattern_cards_markdown")
