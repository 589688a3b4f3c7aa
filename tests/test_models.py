"""Models read their rows once stored, score in one pass, and the log of orders reads each table once."""

import re

from flowlens.operators import cluster
from flowlens.plans import analysis_queries
from flowlens.sources.fixtures import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_models_are_stored(spark):
    t = Tables(spark, FOLDER)
    assert len(re.findall(r"\bRelation ", plan(t.o2c_log()))) == 3
    rows = analysis_queries._late(t)
    assert "Relation " not in plan(rows) and rows.columns == ["case_id", *analysis_queries._COLUMNS, "late"]
    wide = analysis_queries.docs(t)
    assert {(r[0], r[1]) for r in rows.select("case_id", "late").collect()} == {(r[0], int(r[1] > 0)) for r in wide.select("doc_key", "delivery_delay_days").collect() if r[1] is not None}


def test_models_score_in_one_pass(spark):
    df = spark.createDataFrame([(str(i % 50), float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(100)], "case_id string, x double, y double, label int")
    models = [cluster.train_model(df, ["x", "y"], "label", kind) for kind in ("logistic", "forest")]
    got = cluster.predict_cases(df, models)
    assert "Join" not in plan(got) and got.count() == 100  # a key that is there twice is scored twice
    each = [sorted(r["probability"] for r in cluster.predict_cases(df, [m]).collect()) for m in models]
    assert abs(sum(r["probability"] for r in got.collect()) - (sum(each[0]) + sum(each[1])) / 2) < 1e-3


def test_cross_validation_reads_stored_rows(spark, monkeypatch):
    """No fold works the log out again."""
    seen = []
    train = cluster.train_model
    monkeypatch.setattr(cluster, "train_model", lambda rows, *a: seen.append(plan(rows)) or train(rows, *a))
    query = analysis_queries.QUERIES["cross_validate"][0]
    assert query(Tables(spark, FOLDER)).count() == 5
    assert len(seen) == 5 and not any("Relation " in p for p in seen)
