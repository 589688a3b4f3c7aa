"""Readers of exports and mapped rows, on small files."""

import contextlib
import json

import pytest
from flowlens.operators import documents, ocel
from flowlens.sources import readers, tables
from pyspark.sql import functions as F


def test_entities_by_their_names(spark, tmp_path):
    (tmp_path / "orders.json").write_text(json.dumps([{"vbeln": "1", "netwr": 5.0}, {"vbeln": "2", "netwr": 7.5}]))
    (tmp_path / "delivery.json").write_text(json.dumps({"deliveries": [{"delivery": "8", "items": [{"posnr": "10"}]}], "meta": {"n": 1}}))
    found = tables.read_entities(spark, str(tmp_path))
    assert set(found) == {"sales_orders", "deliveries"}
    assert sorted(r["vbeln"] for r in found["sales_orders"].collect()) == ["1", "2"]
    assert found["deliveries"].first()["delivery"] == "8"


def test_sales_csv(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.find_table_files(spark, str(tmp_path))
    (tmp_path / "VBAK.csv").write_text("Sales Document;Net Value;Created Date;Customer\n0000000001;1234,50;05.01.2024;77\n0000000002;N/A;20240106;78\n")
    (tmp_path / "vbap.csv").write_text("vbeln,posnr,matnr,kwmeng\n0000000001,000020,M2,3\n0000000001,000010,M1,\"1,500.5\"\n")
    (tmp_path / "texts.csv").write_bytes("tdname|tdline\n0000000001|Bitte prüfen\n".encode("latin-1"))
    (tmp_path / "VBFA.csv").write_text("vbelv,vbeln,vbtyp_n\n0000000001,0080000001,J\n")
    rows = {r["vbeln"]: r for r in tables.read_sd_csv(spark, str(tmp_path)).collect()}
    one, two = rows["0000000001"], rows["0000000002"]
    assert one["netwr"] == 1234.5 and str(one["erdat"]) == "2024-01-05" and one["kunnr"] == "77" and one["flow"] == ["J:0080000001"]
    assert [i["posnr"] for i in one["items"]] == ["000010", "000020"] and one["items"][0]["kwmeng"] == 1500.5 and one["text"] == "Bitte prüfen"
    assert two["netwr"] is None and two["items"] is None and two["text"] == "" and str(two["erdat"]) == "2024-01-06"


def test_event_log_order_is_that_of_the_file(spark, tmp_path):
    (tmp_path / "log.csv").write_text("case_id,activity,timestamp,resource\n" + "".join(f"c,{i},02-01-2024 10:00:00.000,R\n" for i in range(50)))
    log = readers.read_event_log_csv(spark, str(tmp_path / "log.csv"))
    assert [int(r["activity"]) for r in log.orderBy("event_id").collect()] == list(range(50))


def test_text_lines_stay_in_order(spark, tmp_path):
    (tmp_path / "VBAK.csv").write_text("vbeln,netwr\n0000000001,5\n")
    (tmp_path / "VBAP.csv").write_text("vbeln,posnr\n0000000001,000010\n")
    (tmp_path / "texts.csv").write_text("tdname,tdline\n" + "".join(f"0000000001,line {i} of a text\n" for i in range(400)))
    with small_splits(spark, 1000):
        text = tables.read_sd_csv(spark, str(tmp_path)).first()["text"]
    assert text == " ".join(f"line {i} of a text" for i in range(400))


@contextlib.contextmanager
def small_splits(spark, size):
    """Files are cut into splits of this many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": 0, "spark.sql.files.minPartitionNum": 1}
    for name, value in names.items():
        spark.conf.set(name, str(value))
    yield
    for name in names:
        spark.conf.unset(name)


def test_combined_ledger_in_splits(spark, tmp_path):
    """Sections that are longer than a split, rows without a table, and one table with two headers."""
    head, line, other = "|BUKRS|BELNR|GJAHR|BUDAT|", "|BUKRS|BELNR|GJAHR|BUZEI|WRBTR|", "|NOTHING|KNOWN|"
    rule = "|-----|-----|----|---|"
    first = [head, rule, *(f"|0001|{i}|2024|31.01.2024|" for i in range(300)), rule, ""]
    second = [line, rule, *(f"|0001|{i % 300}|2024|{i:03d}|{i},50-|" for i in range(700)), ""]
    third = [other, *(f"|a|{i}|" for i in range(50)), "   ", "|BELNR|BUKRS|GJAHR|BUZEI|WRBTR|HKONT|", *(f"|{i}|0002|2025|001|1.00|4000|" for i in range(40))]
    (tmp_path / "all.txt").write_text("\n".join([*first, *second, *third]) + "\n")
    whole = {k: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for k, df in readers.read_fi_combined(spark, str(tmp_path / "all.txt")).items()}
    with small_splits(spark, 700):
        lines = readers.placed_lines(spark, str(tmp_path / "all.txt"))
        assert lines.rdd.getNumPartitions() > 20
        cut = {k: sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for k, df in readers.read_fi_combined(spark, str(tmp_path / "all.txt")).items()}
    assert whole == cut and {k: len(v) for k, v in cut.items()} == {"BKPF": 300, "BSEG": 740}


def test_traces_in_splits(spark, tmp_path):
    traces = [{"case_id": i, "attributes": {"note": 'the "case_id" : [x]', "n": "{"}, "events": [{"activity": f"a{k}", "timestamp": f"2024-01-01T00:00:{k:02d}", "who": "}"} for k in range(i % 5)]} for i in range(200)]
    for name, indent in (("flat", None), ("wide", 2)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"metadata": {"source": "x"}, "stats": {"n": 200}, "traces": traces}, indent=indent))
        with small_splits(spark, 2000):
            cut = readers.read_trace_json(spark, str(tmp_path / f"{name}.json"))
            assert cut.rdd.getNumPartitions() > 5
            got = sorted(map(tuple, cut.collect()))
        assert got == sorted(map(tuple, readers.read_trace_json(spark, str(tmp_path / f"{name}.json"), case_first=False).collect()))
        assert len(got) == sum(i % 5 for i in range(200)) and got[0][0] == "1" and got[0][2] == "a0"


def test_texts_of_nested_documents(spark):
    df = spark.sql("""SELECT ' note ' AS notes, array(named_struct('text_content', '', 'text', 'head'), named_struct('text_content', 'body', 'text', cast(null as string))) AS texts,
        array(named_struct('item_text', 'one', 'description', ' two ', 'n', 1), named_struct('item_text', cast(null as string), 'description', '', 'n', 2)) AS items, cast(null as string) AS internal_notes""")
    assert df.select(documents.extract_texts(df).alias("t")).first()["t"] == ["head", "body", "note", "one", "two"]
    plain = spark.sql("SELECT 1 AS a")
    assert plain.select(documents.extract_texts(plain).alias("t")).first()["t"] == []


def test_flow_of_long_chains_and_cycles(spark):
    from flowlens.operators import chain

    edges = [("a", "C", "b", "J"), ("b", "J", "c", "M"), ("c", "M", "d", "N"), ("d", "N", "e", "O"), ("e", "O", "f", "H"), ("f", "H", "g", "K"), ("g", "K", "h", "P"), ("h", "P", "b", "J"), ("a", "C", "c", "M")]
    flow = spark.createDataFrame(edges, "vbelv string, vbtyp_v string, vbeln string, vbtyp_n string")
    found = {r["document"]: r["depth"] for r in chain.doc_flow(flow, spark.createDataFrame([("a",)], "vbeln string")).collect()}
    assert found == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "f": 4, "g": 5, "h": 6}


def test_alerts_are_sorted_and_cut(spark):
    rows = [("a", "high", 0.8), ("b", "critical", 0.7), ("c", "low", 0.99), ("d", "high", 0.9)]
    alerts = spark.createDataFrame(rows, "case_id string, severity string, probability double").withColumn("alert_type", F.lit("x"))
    assert [r["case_id"] for r in documents.sort_alerts(alerts).collect()] == ["b", "d", "a", "c"]
    assert [r["case_id"] for r in documents.sort_alerts(alerts, "high", 2).collect()] == ["b", "d"]


def test_ocel_files(spark, tmp_path):
    log = spark.sql("SELECT 'c' AS case_id, id AS event_id, element_at(array('Record Goods Receipt', 'Record Invoice Receipt'), cast(id % 2 + 1 as int)) AS activity, timestamp_seconds(id) AS ts, 'r' AS resource, 'v' AS vendor FROM range(4)")
    made = ocel.ocel_from_log(log)
    ocel.write_ocel_json(made.objects, made.events, made.object_relations, made.event_objects, str(tmp_path))
    objects = {r["id"]: r for r in spark.read.json(f"{tmp_path}/objects").collect()}
    assert set(objects) == {"po_c", "vendor_v", "gr_c_0", "gr_c_2", "inv_c_1", "inv_c_3"}
    assert sorted((r["objectId"], r["qualifier"]) for r in objects["inv_c_3"]["relationships"]) == [("gr_c_2", "goods_receipt"), ("po_c", "predecessor")]
    assert spark.read.json(f"{tmp_path}/events").count() == 4 and {r["name"] for r in spark.read.json(f"{tmp_path}/event_types").collect()} == {"Record Goods Receipt", "Record Invoice Receipt"}


def test_ocel_document(spark, tmp_path):
    """One valid document, however many files it is; read back it is the log, attributes included."""
    log = spark.sql("SELECT concat('c', id % 3) AS case_id, id AS event_id, element_at(array('Record Goods \"Receipt\"', 'Record Invoice Receipt'), cast(id % 2 + 1 as int)) AS activity, timestamp_millis(id * 1001) AS ts, 'r' AS resource, if(id % 3 = 0, null, 'v,1') AS vendor FROM range(40)")
    made = ocel.ocel_from_log(log)
    ocel.write_ocel_document(made, str(tmp_path / "doc"))
    files = sorted((tmp_path / "doc").glob("part-*"))
    document = json.loads("".join(f.read_text() for f in files))
    assert set(document) == {"objectTypes", "eventTypes", "objects", "events"} and len(document["events"]) == 40
    assert {t["name"]: [a["name"] for a in t["attributes"]] for t in document["objectTypes"]}["purchase_order"] == ["document_number", "vendor_id"]
    first = next(o for o in document["objects"] if o["id"] == "po_c1")
    assert first["attributes"] == {"document_number": "c1", "vendor_id": "v,1"} and first["relationships"] == [{"objectId": "vendor_v,1", "qualifier": "vendor"}]
    again = ocel.read_ocel_document(spark, str(tmp_path / "doc"))
    for before, after in zip(made, again, strict=True):
        pick = lambda df: sorted(repr([tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r]) for r in df.select(sorted(df.columns)).distinct().collect()) if "attributes" not in df.columns else sorted(repr([tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r]) for r in df.select(sorted(df.columns)).collect())
        assert pick(before) == pick(after)
    empty = ocel.Log(*(df.limit(0) for df in made))
    ocel.write_ocel_document(empty, str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part-*")))) == {"objectTypes": [], "eventTypes": [], "objects": [], "events": []}
