"""Functions, models, readers, alerts and streams on hand-written rows."""

import datetime
import json

import pytest
from flowlens.functions import text as X
from flowlens.functions import values as V
from flowlens.operators import conformance, features, ledger, stats
from flowlens.plans import models
from flowlens.sources import readers
from pyspark.sql import functions as F


def one(spark, column, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("2024-01-02", (2024, 1, 2)), ("20240102", (2024, 1, 2)), ("02.01.2024", (2024, 1, 2)), ("2024-01-02T10:00:00Z", (2024, 1, 2, 10)), ("2024-01-02T10:00:00+02:00", (2024, 1, 2, 8)), ("nothing", None)])
def test_parse_date(spark, text, want):
    assert one(spark, V.parse_date(F.col("c0")), text) == (datetime.datetime(*want) if want else None)


@pytest.mark.parametrize(("text", "want"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("1234.56-", -1234.56), ("(500)", -500), ("USD 1,000", 1000), ("12,5", 12.5), ("1.000.000", 1000000), ("x", None)])
def test_parse_amount(spark, text, want):
    got = one(spark, V.parse_sap_amount(F.col("c0")), text)
    assert (float(got) if got is not None else None) == want


@pytest.mark.parametrize(("text", "want"), [("20240131", "20240131"), ("31.01.2024", "20240131"), ("01/31/2024", "20240131"), ("2024-01-31", "20240131"), ("00000000", None)])
def test_parse_sap_date(spark, text, want):
    assert one(spark, V.parse_sap_date(F.col("c0")), text) == want


def test_small_values(spark):
    assert one(spark, V.pad_document(F.col("c0")), "42") == "0000000042"
    assert one(spark, V.strip_zeros(F.col("c0")), "00042") == "42"
    assert one(spark, V.combine_datetime(F.col("c0"), F.col("c1")), "20240102", "101112") == datetime.datetime(2024, 1, 2, 10, 11, 12)
    assert [one(spark, V.format_duration(F.col("c0")), h) for h in (0.5, 5.0, 48.0, 336.0)] == ["30m", "5.0h", "2.0d", "2.0w"]
    assert one(spark, V.normalize_activity(F.col("c0")), "GoodsIssued now") == "goods_issued_now"
    assert one(spark, V.detect_process_type(F.array("c0", "c1")), "Vendor invoice", "Purchase order") == "P2P"
    assert one(spark, V.clean_metric(F.col("c0")), "NaN") is None and one(spark, V.clean_metric(F.col("c0")), "2.5") == 2.5
    assert one(spark, V.mask_params(F.create_map(F.lit("Password"), F.col("c0"), F.lit("x"), F.col("c0"))), "abc") == {"Password": "***", "x": "abc"}


def test_redaction(spark):
    text = "Mail a.b@c.com, call 123-456-7890, PO-ABCD-123456 for 0012345678, Mr. John Smith, SO12345678, ERNAM: USER1"
    got = one(spark, X.redact_text(F.col("c0"), "salt"), text)
    assert "[EMAIL]" in got and "[PHONE]" in got and "[PO_NUMBER_" in got and "[NAME], SO[DOC_" in got and "ERNAM: [NAME]" in got and "[DOC_" in got and "0012345678" not in got
    assert got == one(spark, X.redact_text(F.col("c0"), "salt"), text) != one(spark, X.redact_text(F.col("c0"), "other"), text)


def test_text_functions_know_all_letters(spark):
    assert one(spark, X.tokenize(F.col("c0")), "Café naïve straße 漢字") == ["café", "naïve", "straße", "漢字"]
    assert one(spark, X.normalize_text(F.col("c0")), "ordé ord") == "ordé order"
    assert one(spark, X.redact_text(F.col("c0")), "nothing here") == "nothing here"
    assert one(spark, X.redact_text(F.col("c0"), hash_documents=False, hash_orders=False), "PO 123456 of 0012345678") == "[PO_NUMBER] of 0012345678"


def test_redact_struct(spark):
    df = spark.sql("SELECT 'a.b@c.de' AS a, named_struct('b', array('x', 'c.d@e.fr'), 'n', 1) AS s, map('k', 'g.h@i.jp') AS m, array(named_struct('t', 'j.k@l.com')) AS r")
    got = X.redact_struct(df, "s").first()
    assert got["a"] == "[EMAIL]" and got["s"]["b"] == ["x", "[EMAIL]"] and got["s"]["n"] == 1 and got["m"] == {"k": "[EMAIL]"} and got["r"][0]["t"] == "[EMAIL]"
    assert X.redact_struct(df, "s", keep=("a",)).first()["a"] == "a.b@c.de" and X.redact_struct(df, mode="raw_local").first() == df.first()


def test_parse_date_with_offset(spark):
    assert str(one(spark, V.parse_date(F.col("c0")), "2024-01-05T10:00:00+02:00")) == "2024-01-05 08:00:00"
    assert str(one(spark, V.parse_date(F.col("c0")), "2024-01-05 10:00:00-0530")) == "2024-01-05 15:30:00"
    assert str(one(spark, V.parse_date(F.col("c0")), "2024-01-05T10:00:00Z")) == "2024-01-05 10:00:00"


def test_normalise(spark):
    assert one(spark, X.normalize_text(F.col("c0")), "CUST REQ:  System generated CR HLD on   QTY..") == "customer request: credit hold on quantity."
    assert one(spark, X.phrases(X.tokenize(F.col("c0")), 2, 3), "a b c") == ["a b", "b c", "a b c"]
    assert one(spark, X.extract_keywords(F.col("c0")), "What are the late deliveries of vendors in January") == ["late", "deliveries", "vendors"]


def log(spark, *cases):
    rows = [(f"case{i}", a, datetime.datetime(2024, 1, 1 + k), k) for i, case in enumerate(cases) for k, a in enumerate(case)]
    return spark.createDataFrame(rows, "case_id string, activity string, ts timestamp, event_id long")


def test_known_traces(spark):
    o, d, g, i = "OrderCreated", "DeliveryCreated", "GoodsIssued", "InvoiceCreated"
    events = log(spark, [o, d, g, i], [d, g, i], [o, d, i, g], [o, g, i], ["VA01", "VL01N", "VL06G", "VF01"])
    model = models.o2c_simple()
    got = {r["case_id"]: r for r in conformance.check_conformance(events, model.frame(spark), model.name_frame(spark)).collect()}
    assert got["case0"]["is_conformant"] and got["case4"]["is_conformant"]
    assert not any(got[f"case{k}"]["is_conformant"] for k in (1, 2, 3))
    detailed = models.o2c_detailed()
    changed = log(spark, [o, "OrderChanged", d, g, i])
    assert conformance.check_conformance(changed, detailed.frame(spark), detailed.name_frame(spark)).first()["is_conformant"]


def test_unknown_names_are_unexpected(spark):
    model = models.OrderedModel("m", [("a", True, ()), ("b", True, ("a",))], {"A1": "a", "B1": "gone"})
    found = conformance.ordered_deviations(log(spark, ["A1", "B1"]), model.frame(spark), model.name_frame(spark))
    assert {(r["deviation_type"], r["activity"]) for r in found.collect()} == {("unexpected_activity", "B1"), ("missing_activity", "b")}


def test_document_categories_are_found(spark):
    model = models.o2c_ordered()
    got = conformance.check_ordered(log(spark, ["C", "J", "R", "M"]), model.frame(spark), model.name_frame(spark)).first()
    assert got["fitness"] == 1.0 and got["n_deviations"] == 0


def test_model_order():
    assert models.o2c_simple().order() == {"OrderCreated": 0, "DeliveryCreated": 1, "GoodsIssued": 2, "InvoiceCreated": 3}
    loop = models.Model("x").activity("a").activity("b").sequence("a", "b", "a")
    assert set(loop.order()) == {"a", "b"}
    assert all(make().name == name for name, make in models.MODELS.items())


def test_rest_and_cap(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [("c", "late_delivery", 0.95, start + datetime.timedelta(minutes=m)) for m in (0, 10, 29, 30, 61, 200)]
    hits = features.threshold_hits(spark.createDataFrame(rows, "case_id string, prediction_type string, probability double, ts timestamp"))
    got = sorted((r["severity"], int((r["ts"] - start).total_seconds() // 60)) for r in features.threshold_alerts(hits).collect())
    assert got == [("critical", 0), ("critical", 30), ("critical", 61), ("critical", 200), ("high", 0), ("high", 61), ("high", 200)]
    assert features.threshold_alerts(hits, most=3).count() == 3


def test_weighted_risk_excludes_heuristics(spark):
    rows = [("a", "late_delivery", 0.5, "probability"), ("a", "credit_hold", 0.9, "heuristic"), ("a", "completion_time", 500.0, "raw"), ("b", "credit_hold", 0.9, "heuristic")]
    df = spark.createDataFrame(rows, "case_id string, prediction_type string, value double, value_type string")
    got = {r["case_id"]: (r["risk_score"], r["n_excluded"]) for r in features.weighted_risk(df).collect()}
    assert got == {"a": (0.5, 2), "b": (0.0, 1)}
    assert {r["case_id"]: r["risk_score"] for r in features.weighted_risk(df, 1000.0).collect()}["a"] == 0.5


def test_tails():
    assert abs(stats.t_two_sided(2.228138852, 10) - 0.05) < 1e-8 and abs(stats.t_quantile(10) - 2.228138852) < 1e-6
    assert abs(stats.normal_two_sided(1.959963985) - 0.05) < 1e-9


def test_effects_of_known_groups(spark):
    rows = [(f"d{i}", "x" if i % 2 else "y", 10 + (i % 7) + (8 if i % 2 else 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_key string, cluster string, order_to_delivery_days int").selectExpr("*", *(f"cast(null as int) as {m}" for m in stats.METRICS[1:]), "'t' as text")
    effects = stats.cluster_effects(df)
    got = {r["cluster"]: r for r in effects.collect()}
    assert got["x"]["is_significant"] and got["x"]["effect"] == "large" and got["x"]["difference"] > 0 > got["y"]["difference"]
    cards = {r["cluster"]: r for r in stats.pattern_cards(df, effects).collect()}
    assert cards["x"]["metric"] == "order_to_delivery_days" and cards["x"]["effect"] == "large"


def test_fi_lines(spark):
    text = ["|BUKRS|BELNR|GJAHR|BUZEI|WRBTR|AUGDT|", "|-----|-----|----|---|---|---|", "|0001|42|2024|001|1.234,50-|31.01.2024|", "", '|0001|"43"|2024|002|10.00||']
    got = readers.read_fi_lines(spark.createDataFrame([(x,) for x in text], "value string")).collect()
    assert [(r["BELNR"], float(r["WRBTR"]), r["AUGDT"]) for r in got] == [("42", -1234.5, datetime.date(2024, 1, 31)), ("43", 10.0, None)]
    assert readers.detect_fi_table(got[0].__fields__) == "BSEG"


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "a.csv").write_text("VBELN;ERDAT;NETWR\n1;2024-01-01;5\n2;null;6\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.select("order_number", "order_date", "net_value").orderBy("order_number").collect()] == [("1", "2024-01-01", "5"), ("2", None, "6")]
    found = {r["column"]: r["status"] for r in readers.validate_schema(df, ["order_number", "order_date", "gone"]).collect()}
    assert found == {"order_number": "ok", "order_date": "ok", "gone": "error"}
    (tmp_path / "t.json").write_text(json.dumps({"traces": [{"case_id": 7, "events": [{"activity": "a", "timestamp": "2024-01-01T00:00:00"}, {"activity": "b", "timestamp": "2024-01-02T00:00:00"}]}]}))
    assert [(r["case_id"], r["activity"]) for r in readers.read_trace_json(spark, str(tmp_path / "t.json")).orderBy("event_id").collect()] == [("7", "a"), ("7", "b")]
    lines = spark.createDataFrame([("1", "0001", "E", 2, "b"), ("1", "0001", "E", 1, "a")], "TDNAME string, TDID string, TDSPRAS string, line_no int, TDLINE string")
    assert readers.join_text_lines(lines).first()["text"] == "a\nb"


def test_stream_same_as_batch(spark, tmp_path):
    from flowlens.streaming.alerts import stream_activity_counts

    rows = [("c", "a", datetime.datetime(2024, 1, 1, h, 30)) for h in range(5)]
    spark.createDataFrame(rows, "case_id string, activity string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("case_id string, activity string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream_activity_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select sum(n), count(*) from counts").first() == (5, 5)


def test_thresholds_are_parameters(spark):
    head = spark.createDataFrame([("1", "2", "2024", datetime.date(2024, 1, 1), datetime.date(2024, 1, 11), "u", 5)], "BUKRS string, BELNR string, GJAHR string, BUDAT date, CPUDT date, USNAM string, debit int")
    assert ledger.journal_backdated(head).count() == 0
    assert ledger.journal_backdated(head, ledger.Thresholds(backdate_days=5)).count() == 1
