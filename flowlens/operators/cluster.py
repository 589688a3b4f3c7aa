"""Text clustering and trained models with MLlib: TF-IDF, k-means, density, classifiers and regressors."""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import density, manyk, terms
from .shared import checkpointed

SEED = 42
#: Labels of texts that take no part: noise, empty, all the same.
NOISE, EMPTY, IDENTICAL = -1, -2, -3


def tfidf(texts: DataFrame, text: str = "text", max_terms: int = 5000, min_df: float = 2, max_df: float = 0.95) -> tuple[DataFrame, list[str]]:
    """texts with `vector`, normalised TF-IDF of one to three words with idf ln((1+n)/(1+df))+1, and the terms. Where no
    term is in as many texts as asked for, all terms count."""
    steps = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+", minTokenLength=2), StopWordsRemover(inputCol="_words", outputCol="_kept")]
    steps += [NGram(n=n, inputCol="_kept", outputCol=f"_n{n}") for n in (2, 3)]
    steps += [SQLTransformer(statement="SELECT *, concat(_kept, _n2, _n3) AS _terms FROM __THIS__")]
    tokens = PipelineModel(steps[:2]).transform(texts.where(F.col(text).isNotNull()).select(text))
    n, n_filled = texts.agg(F.count("*"), F.count(text)).first()
    share = lambda df: df if df >= 1 else df * n_filled
    found = terms.frequent(tokens, max_terms, share(min_df), share(max_df)) or terms.frequent(tokens, max_terms, 1, n_filled)
    vocabulary, weights = [t for t, _ in found], [1 + math.log((n + 1) / (df + 1)) for _, df in found]
    # vectors stay sparse: what isn't in a text is stored nowhere
    steps += [CountVectorizerModel.from_vocabulary(vocabulary, "_terms", "_counts"), ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol="_counts", outputCol="_sum"), Normalizer(inputCol="_sum", outputCol="vector")]
    out = PipelineModel(steps).transform(texts.na.fill("", [text]))
    return out.drop("_words", "_kept", "_n2", "_n3", "_terms", "_counts", "_sum"), vocabulary


def k_qualities(vectors: DataFrame, low: int = 3, high: int = 15) -> DataFrame | None:
    """k, n, cost and silhouette for each k that may be chosen, all fitted in the same passes; None for few vectors."""
    rows = manyk.sparse_rows(vectors)
    ks = list(range(low, min(high, rows.count() // 3) + 1))
    if len(ks) < 3:
        return None
    return checkpointed(manyk.qualities(rows, manyk.fit_all(rows, ks)))


def choose_k(vectors: DataFrame, low: int = 3, high: int = 15) -> int:
    """The elbow: the k furthest from the chord of the costs, else the one of the best silhouette; few vectors have the
    root of half their number."""
    found = k_qualities(vectors, low, high)
    if found is None:
        n = vectors.count()
        return max(2, min(n - 1, round((n / 2) ** 0.5)))
    return manyk.elbow([(r["k"], r["cost"], r["silhouette"]) for r in found.collect()])  # a row for each k


def cluster_texts(texts: DataFrame, k: int | None = None, text: str = "text") -> DataFrame:
    """texts with `cluster`; empty texts get -2, all identical ones -3, and with under three distinct ones all get -1."""
    filled = texts.where(F.trim(F.coalesce(text, F.lit(""))) != "")
    distinct = filled.select(text).distinct().limit(3).count()
    if distinct < 3:
        label = IDENTICAL if distinct == 1 else NOISE
        return texts.withColumn("cluster", F.when(F.trim(F.coalesce(text, F.lit(""))) == "", EMPTY).otherwise(label))
    vectors, _ = tfidf(filled, text)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)  # up to 13 fits and their passes read it
    model = KMeans(k=k or choose_k(vectors), seed=SEED, featuresCol="vector", predictionCol="cluster").fit(vectors)
    found = model.transform(vectors).drop("vector")
    vectors.unpersist()  # later passes work the vectors out again
    empty = texts.where(F.trim(F.coalesce(text, F.lit(""))) == "").withColumn("cluster", F.lit(EMPTY))
    return found.unionByName(empty)


def silhouette(clustered: DataFrame, features: str = "vector") -> float:
    return ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(clustered)


def top_phrases(vectors: DataFrame, phrases: list[str], top: int = 10) -> DataFrame:
    """cluster, rank, phrase, weight: the largest mean weights of each cluster."""
    names = vectors.sparkSession.createDataFrame(list(enumerate(phrases)), "position int, phrase string")
    sizes = vectors.groupBy("cluster").agg(F.count("*").alias("_n"))
    weights = vectors.select("cluster", F.explode(manyk.entries(F.col("vector"))).alias("e")).select("cluster", F.col("e.at").alias("position"), F.col("e.x").alias("w")).where("w > 0").groupBy("cluster", "position").agg(F.sum("w").alias("_w"))
    mean = weights.join(sizes, "cluster").join(F.broadcast(names), "position").select("cluster", "phrase", F.round(F.col("_w") / F.col("_n"), 6).alias("weight"))
    best = Window.partitionBy("cluster").orderBy(F.desc("weight"), "phrase")
    return mean.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def topics(texts: DataFrame, k: int | None = None, text: str = "text", top: int = 10) -> tuple[DataFrame, float]:
    """cluster, rank, phrase, weight and theme (the first three phrases) of the clusters of texts, and their silhouette."""
    vectors, vocabulary = tfidf(texts.where(F.trim(F.coalesce(text, F.lit(""))) != ""), text)
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    found = KMeans(k=k or choose_k(vectors), seed=SEED, featuresCol="vector", predictionCol="cluster").fit(vectors).transform(vectors)
    best = top_phrases(found, vocabulary, top)
    theme = best.where("rank <= 3").groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "phrase")))["phrase"], ", ").alias("theme"))
    return best.join(theme, "cluster"), silhouette(found)


def embedding_clusters(vectors: DataFrame, k: int, embedding: str = "embedding") -> DataFrame:
    """vectors with `cluster` by k-means on their normalised embeddings."""
    made = Normalizer(inputCol="_v", outputCol="vector").transform(vectors.where(F.col(embedding).isNotNull()).withColumn("_v", array_to_vector(F.col(embedding).cast("array<double>"))))
    return KMeans(k=k, seed=SEED, featuresCol="vector", predictionCol="cluster").fit(made).transform(made).drop("_v", "vector")


#: Points that the distance of density clusters is taken from, where none is given.
SAMPLE = 1000


def k_distance(points: DataFrame, k: int, share: float = 0.9, sample: int = SAMPLE) -> float:
    """The distance to the k-th neighbour that a share of the points keeps within, over at most `sample` points chosen by
    a hash (they come to the driver); points: id, v."""
    some = np.array([row["v"].toArray() for row in points.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(sample).select("v").collect()])
    if len(some) <= k:
        return 1.0
    squares = (some**2).sum(1)
    distance = np.sqrt(np.maximum(squares[:, None] + squares - 2 * some @ some.T, 0))
    return float(np.quantile(np.partition(distance, k, axis=1)[:, k], share)) or 1e-9


def spread_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster: the least id of each connected part. Each round takes the least label of the neighbours and then the
    label of that label, so parts of any width settle in few rounds; it ends when nothing changes."""
    labels = checkpointed(nodes.select("id", F.col("id").alias("cluster")))
    while True:
        least = edges.join(labels.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("m"))
        near = labels.join(least, labels["id"] == least["a"], "left").select("id", F.col("cluster").alias("old"), F.least("cluster", F.coalesce("m", "cluster")).alias("cluster"))
        jump = near.select(F.col("id").alias("_i"), F.col("cluster").alias("_c"))
        now = checkpointed(near.join(jump, F.col("cluster") == F.col("_i")).select("id", "old", F.least("cluster", "_c").alias("cluster")))
        labels = now.drop("old")
        if now.where("cluster <> old").isEmpty():
            return labels


def density_clusters(vectors: DataFrame, key: str, eps: float | None = None, min_points: int = 5, embedding: str = "embedding", block: int = density.BLOCK) -> DataFrame:
    """key, cluster by density: core points have min_points points, themselves included, within eps (by default the
    distance to the min_points-th neighbour that nine in ten points keep within); -1 is noise. Neighbours are exact; a
    cluster is named by its least core point, and a border point takes the least name near it."""
    points = vectors.where(F.col(embedding).isNotNull()).select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    eps = eps or k_distance(points.withColumn("v", array_to_vector("v")), min_points)
    pivots = density.choose_pivots(points)
    counts = density.near_counts(points.withColumn("core", F.lit(False)), pivots, eps, block)
    marked = checkpointed(points.join(counts.select("id", (F.col("n") >= min_points).alias("core")), "id"))
    edges = checkpointed(density.core_edges(marked, pivots, eps, block).distinct())
    links = edges.where("core and id != to").select(F.col("id").alias("a"), F.col("to").alias("b"))
    labels = spread_labels(marked.where("core").select("id"), links.union(links.select("b", "a")))
    border = edges.where("not core").join(labels.select(F.col("id").alias("to"), "cluster"), "to").groupBy("id").agg(F.min("cluster").alias("cluster"))
    return points.select("id").join(labels.union(border), "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


CLASSIFIERS = {"gbt": lambda: GBTClassifier(seed=SEED, maxIter=20), "forest": lambda: RandomForestClassifier(seed=SEED, numTrees=30), "logistic": lambda: LogisticRegression()}
REGRESSORS = {"gbt": lambda: GBTRegressor(seed=SEED, maxIter=20), "forest": lambda: RandomForestRegressor(seed=SEED, numTrees=30), "linear": lambda: LinearRegression(elasticNetParam=0.0, regParam=0.1)}


def split(rows: DataFrame, label: str, key: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """A split by a hash of the key within each label, so it is the same in every run."""
    part = F.pmod(F.xxhash64(F.lit(SEED), key, label), F.lit(100)) < int(share * 100)
    return rows.where(part), rows.where(~part)


def train_model(rows: DataFrame, features: list[str], label: str, kind: str = "gbt", regression: bool = False) -> PipelineModel:
    estimator = (REGRESSORS if regression else CLASSIFIERS)[kind]().setLabelCol(label).setFeaturesCol("_scaled")
    steps = [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="skip"), StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True), estimator]
    return Pipeline(stages=steps).fit(rows.withColumn(label, F.col(label).cast("double")))


def feature_matrix(rows: DataFrame, features: list[str], key: str = "case_id", to: str = "features") -> DataFrame:
    """key and a vector of the features in their fixed order; missing values are zero."""
    filled = rows.select(key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features))
    return VectorAssembler(inputCols=features, outputCol=to).transform(filled).select(key, to)


def cross_validate(rows: DataFrame, features: list[str], label: str, key: str, kind: str = "gbt", folds: int = 5) -> DataFrame:
    """fold, accuracy, precision, recall, f1 of a classifier that is fitted on the other folds; folds go by a hash of the key."""
    part = F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(folds))
    found = None
    for fold in range(folds):
        model = train_model(rows.where(part != fold), features, label, kind)
        one = classifier_metrics(model.transform(rows.where(part == fold)), label).select(F.lit(fold).alias("fold"), "*")
        found = one if found is None else found.unionByName(one)
    return found


def importances(model: PipelineModel, features: list[str]) -> DataFrame:
    """feature, importance of a trained model, adding up to one: of trees their own, else sizes of the coefficients."""
    last = model.stages[-1]
    weights = np.asarray(last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray()))
    total = weights.sum() or 1.0
    return SparkSession.active().createDataFrame([(f, float(w / total)) for f, w in zip(features, weights, strict=True)], "feature string, importance double")


def scored_by_all(rows: DataFrame, models: list[PipelineModel], of: Column) -> DataFrame:
    """rows with what each model gives as p0, p1, ..., in one pass."""
    for i, model in enumerate(models):
        rows = model.transform(rows).withColumn(f"p{i}", of).drop("_raw", "_scaled", "rawPrediction", "probability", "prediction")
    return rows


def predict_values(rows: DataFrame, models: list[PipelineModel], key: str = "case_id") -> DataFrame:
    """key and the mean prediction of regression models."""
    found = scored_by_all(rows, models, F.col("prediction"))
    return found.select(key, (sum(F.col(f"p{i}") for i in range(len(models))) / len(models)).alias("prediction"))


def tree_interval(rows: DataFrame, model: PipelineModel, z: float = 1.645) -> DataFrame:
    """rows with prediction, lower, upper and confidence by how far the trees of a forest lie apart."""
    prepared = PipelineModel(model.stages[:-1]).transform(rows)
    trees = model.stages[-1].trees
    for i, tree in enumerate(trees):
        prepared = tree.copy().setFeaturesCol("_scaled").setPredictionCol(f"_t{i}").transform(prepared)
    every = F.array(*(F.col(f"_t{i}") for i in range(len(trees))))
    mean = F.aggregate(every, F.lit(0.0), lambda a, x: a + x) / len(trees)
    spread = F.sqrt(F.aggregate(every, F.lit(0.0), lambda a, x: a + x * x) / len(trees) - mean * mean)
    scored = prepared.withColumns({"prediction": mean, "_s": F.coalesce(F.nanvl(spread, F.lit(0.0)), F.lit(0.0))}).drop("_raw", "_scaled", *(f"_t{i}" for i in range(len(trees))))
    return with_interval(scored, F.col("_s") * z).drop("_s")


def confidence_band(p):
    return F.when((p >= 0.7) | (p <= 0.3), "high").when((p >= 0.6) | (p <= 0.4), "medium").otherwise("low")


def predict_cases(rows: DataFrame, models: list[PipelineModel], key: str = "case_id") -> DataFrame:
    """key, probability (mean of the models), label and confidence."""
    found = scored_by_all(rows, models, vector_to_array("probability")[1])
    p = sum(F.col(f"p{i}") for i in range(len(models))) / len(models)
    return found.select(key, F.round(p, 6).alias("probability"), (p >= 0.5).cast("int").alias("label"), confidence_band(p).alias("confidence"))


def classifier_metrics(scored: DataFrame, label: str) -> DataFrame:
    """One row of accuracy, precision, recall and F1; scored: label (0/1) and the predicted `prediction`."""
    y, p = F.col(label).cast("int") == 1, F.col("prediction").cast("int") == 1
    counts = scored.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def area_under_curve(scored: DataFrame, label: str) -> float:
    return BinaryClassificationEvaluator(labelCol=label).evaluate(scored.withColumn(label, F.col(label).cast("double")))


def regression_metrics(scored: DataFrame, label: str) -> DataFrame:
    e = F.col(label) - F.col("prediction")
    return scored.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(label) * F.count("*"))).alias("r2"))


def with_interval(scored: DataFrame, half) -> DataFrame:
    p = F.col("prediction")
    width = 2 * half / F.greatest(F.abs(p), F.lit(1e-9))
    return scored.withColumns({"lower": F.greatest(p - half, F.lit(0.0)), "upper": p + half, "confidence": F.when(width < 0.2, "high").when(width < 0.5, "medium").otherwise("low")})


def prediction_interval(scored: DataFrame, rmse: float, z: float = 1.645) -> DataFrame:
    """scored with lower, upper and a confidence by the width relative to the prediction."""
    return with_interval(scored, F.lit(z * rmse))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
