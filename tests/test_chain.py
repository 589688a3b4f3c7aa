"""The document flow: chains of any length, cycles and branches."""

from flowlens.operators import chain


def test_doc_flow_reaches_all(spark):
    edges = [(f"d{i}", "C", f"d{i + 1}", "J") for i in range(9)] + [("d9", "J", "d0", "C"), ("d0", "C", "x", "M"), ("d3", "J", "x", "M")]
    flow = spark.createDataFrame(edges, "vbelv string, vbtyp_v string, vbeln string, vbtyp_n string")
    found = chain.doc_flow(flow, spark.createDataFrame([("d0",), ("alone",)], "vbeln string")).collect()
    assert sorted((r["root"], r["document"], r["depth"]) for r in found) == sorted([("alone", "alone", 0), *(("d0", f"d{i}", i) for i in range(10)), ("d0", "x", 1)])
