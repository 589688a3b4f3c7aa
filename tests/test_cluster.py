"""Clustering and trained models: domains of labels, known groups, and the same results twice."""

import collections
import random

import numpy as np
import pytest

from flowlens.operators import cluster, density
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F


def test_density(spark):
    rng = random.Random(1)
    rows = [(i, [c + rng.gauss(0, 0.05), c + rng.gauss(0, 0.05)]) for i, c in enumerate([0.0] * 20 + [5.0] * 20)] + [(99, [50.0, -50.0])]
    found = {r["id"]: r["cluster"] for r in cluster.density_clusters(spark.createDataFrame(rows, "id long, embedding array<double>"), "id", 0.5).collect()}
    assert {found[i] for i in range(20)} == {0} and {found[i] for i in range(20, 40)} == {20} and found[99] == cluster.NOISE


def slow_density(rows, eps, least):
    ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
    near = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    label = {}
    for i in np.argsort(ids):
        if core[i] and i not in label:
            label[i], open_ = ids[i], [i]
            while open_:
                for j in np.flatnonzero(near[open_.pop()] & core):
                    if j not in label:
                        label[j] = ids[i]
                        open_.append(j)
    out = {}
    for i in range(len(ids)):
        found = [label[j] for j in np.flatnonzero(near[i] & core)]
        out[ids[i]] = label[i] if core[i] else min(found, default=cluster.NOISE)
    return out


@pytest.mark.parametrize("block", [2048, 64])
def test_density_same_as_all_pairs(spark, block):
    """2,000 points: dense and thin groups, copies, a chain, points exactly eps apart, and a hot cell."""
    draw = np.random.default_rng(5)
    groups = [draw.normal(c, s, (n, 6)) for c, s, n in ((0, 0.1, 700), (3, 0.5, 400), (6, 1.0, 300), (-4, 2.0, 200))]
    chain = np.zeros((150, 6))
    chain[:, 0] = 20 + 0.5 * np.arange(150)
    rows = [(int(i), x) for i, x in enumerate(np.concatenate([*groups, chain, np.full((50, 6), 9.0), draw.uniform(-20, 20, (200, 6))]).tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    got = {r["id"]: r["cluster"] for r in cluster.density_clusters(df, "id", 0.5, 3, block=block).collect()}
    want = slow_density(rows, 0.5, 3)
    assert got == want and len(set(want.values())) > 4
    points = df.select("id", F.col("embedding").alias("v"), F.lit(False).alias("core"))
    counts = {r["id"]: r["n"] for r in density.near_counts(points, density.choose_pivots(points, 16), 0.5, block).collect()}
    v = np.array([x for _, x in rows])
    assert [counts[i] for i, _ in rows] == (np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)) <= 0.5).sum(1).tolist()


def test_density_edges_are_few(spark):
    """A thousand equal points give about a thousand edges, not half a million pairs."""
    df = spark.range(1000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"), F.lit(True).alias("core"))
    edges = density.core_edges(df, density.choose_pivots(df), 0.1).distinct()
    assert edges.count() <= 2000
    assert cluster.density_clusters(df.withColumnRenamed("v", "embedding"), "id", 0.1).agg(F.min("cluster"), F.max("cluster")).first() == (0, 0)


def test_special_labels(spark):
    same = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "id int, text string")
    assert {r["id"]: r["cluster"] for r in cluster.cluster_texts(same).collect()} == {1: cluster.IDENTICAL, 2: cluster.IDENTICAL, 3: cluster.EMPTY, 4: cluster.EMPTY}


def test_texts_and_phrases(spark):
    rows = [(i, ("late delivery of goods number %d" if i % 2 else "credit hold on customer account %d") % (i % 5)) for i in range(40)]
    texts = spark.createDataFrame(rows, "id int, text string")
    once, twice = ({r["id"]: r["cluster"] for r in cluster.cluster_texts(texts, 2).collect()} for _ in range(2))
    assert once == twice and len({once[i] for i in range(1, 40, 2)}) == 1 and once[0] != once[1]
    vectors, terms = cluster.tfidf(texts)
    labelled = vectors.withColumn("cluster", F.col("id") % 2)
    best = {(r["cluster"], r["phrase"]) for r in cluster.top_phrases(labelled, terms, 5).collect()}
    assert any(c == 1 and "delivery" in p for c, p in best)


def test_classifier(spark, tmp_path):
    rng = random.Random(2)
    rows = [(str(i), x, y := rng.random(), int(x + y > 1)) for i in range(300) for x in [rng.random()]]
    df = spark.createDataFrame(rows, "case_id string, x double, y double, label int")
    train, test = cluster.split(df, "label", "case_id")
    model = cluster.train_model(train, ["x", "y"], "label", "logistic")
    scored = model.transform(test.withColumn("label", F.col("label").cast("double")))
    assert cluster.classifier_metrics(scored, "label").first()["accuracy"] > 0.85 and cluster.area_under_curve(scored, "label") > 0.9
    cluster.save_model(model, str(tmp_path / "m"))
    again = cluster.load_model(str(tmp_path / "m"))
    assert cluster.predict_cases(test, [model]).collect() == cluster.predict_cases(test, [again]).collect()


def test_all_k_at_once(spark):
    """Known groups: the elbow is at their number, centers are means, cost and silhouette are those of a slow version."""
    draw = np.random.default_rng(3)
    means = draw.normal(size=(5, 8)) * 10
    v = np.concatenate([m + draw.normal(size=(40, 8)) * 0.2 for m in means])
    v[draw.random(v.shape) < 0.2] = 0.0
    df = spark.createDataFrame([(row,) for row in v.tolist()], "v array<double>").repartition(3).select(array_to_vector("v").alias("vector"))
    rows = cluster.manyk.sparse_rows(df)
    centers = cluster.manyk.fit_all(rows, [3, 4, 5, 6, 7])
    got = {r["k"]: r for r in cluster.manyk.qualities(rows, centers).collect()}
    for k, c in centers.items():
        far = ((v[:, None] - c[None]) ** 2).sum(2)
        near = np.sort(np.sqrt(far), axis=1)
        assert got[k]["n"] == 200 and np.isclose(got[k]["cost"], far.min(1).sum()) and np.isclose(got[k]["silhouette"], ((near[:, 1] - near[:, 0]) / near[:, 1]).mean())
        own = far.argmin(1)
        assert all(np.allclose(c[i], v[own == i].mean(0), atol=1e-4) for i in range(k) if (own == i).any())
    assert cluster.manyk.elbow([(k, 100.0 - k, s) for k, s in ((3, 0.1), (4, 0.9), (5, 0.2))]) == 4
    assert cluster.manyk.elbow([(3, 100.0, 0.1), (4, 20.0, 0.1), (5, 10.0, 0.5), (6, 5.0, 0.1)]) == 4
    assert cluster.choose_k(df.limit(5)) == 2


@pytest.mark.parametrize(("most", "least_df", "share"), [(5, 2, 1.0), (40, 2, 0.95), (200, 3, 0.5), (10_000, 1, 1.0), (60, 9, 0.9)])
def test_frequent_terms_same_as_slow_version(spark, monkeypatch, most, least_df, share):
    """Words, pairs and triples by how often they occur, the number of their texts, ties by name; a few words at once."""
    monkeypatch.setattr(cluster.terms, "AT_ONCE", 50)
    draw = random.Random(6)
    texts = [[draw.choice("a b b c c c d dd é 漢".split()) for _ in range(draw.randrange(12))] for _ in range(60)] + [[], ["once"], ["on", "and", "on"] * 9, ["hot"] * 300]
    n, df = collections.Counter(), collections.Counter()
    for words in texts:
        own = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
        n.update(own)
        df.update(set(own))
    want = [(t, df[t]) for t in sorted(n, key=lambda t: (-n[t], t)) if least_df <= df[t] <= share * len(texts)][:most]
    rows = spark.createDataFrame([(w,) for w in texts], "_kept array<string>").repartition(3)
    assert cluster.terms.frequent(rows, most, least_df, share * len(texts)) == want


def test_vectors_stay_sparse(spark):
    """A text's vector holds what is in the text, not a number for each term; weights are those of the formula."""
    texts = spark.createDataFrame([(i, f"word{i % 50} common other{i % 7}") for i in range(100)] + [(100, None), (101, "")], "id int, text string")
    vectors, names = cluster.tfidf(texts, max_df=1.0)
    got = {r["id"]: r["vector"] for r in vectors.collect()}
    assert len(got) == 102 and len(names) > 100 and all(len(v.toArray()) == len(names) and type(v).__name__ == "SparseVector" and v.numNonzeros() <= 6 for v in got.values())
    weight = {t: 1 + np.log(103 / (1 + sum(f" {t} " in f" word{i % 50} common other{i % 7} " for i in range(100)))) for t in names}
    own = np.array([weight[t] if f" {t} " in " word3 common other3 " else 0.0 for t in names])
    assert np.allclose(got[3].toArray(), own / np.sqrt((own**2).sum()))
    pairs = vectors.where("id = 3").select(cluster.manyk.entries(F.col("vector"))).first()[0]
    assert {(p["at"], round(p["x"], 9)) for p in pairs} == {(i, round(float(x), 9)) for i, x in enumerate(got[3].toArray()) if x}


def test_qualities_are_stored(spark):
    """One pass over wide vectors tells them all; asking again reads a row for each k."""
    draw = np.random.default_rng(8)
    df = spark.createDataFrame([(row,) for row in draw.normal(size=(60, 4)).tolist()], "v array<double>").select(array_to_vector("v").alias("vector"))
    found = cluster.k_qualities(df, 3, 6)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["k"] for r in found.collect()) == [3, 4, 5, 6] and found.agg(F.sum("n")).first()[0] == 240


def test_rounds_send_centers_few_times(spark):
    df = spark.createDataFrame([([float(i), 1.0],) for i in range(90)], "v array<double>").repartition(40).select(array_to_vector("v").alias("vector"))
    rows = cluster.manyk.sparse_rows(df)
    assert rows.count() == 90 and rows.rdd.getNumPartitions() <= max(2, spark.sparkContext.defaultParallelism)
