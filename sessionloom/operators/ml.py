"""Training and clustering on Spark ML. Row choice is by seeded hash; figures depend on the estimators."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.operators import metrics


def vectors(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def kmeans_search(df: DataFrame, ks: range = range(4, 21), seed: int = 42, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """(rows with cluster of the best k, one row a k with its silhouette). Ties go to the smaller k."""
    df = df.cache()
    n = df.count()
    scores, best = [], None
    for k in (k for k in ks if k < n):
        model = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df)
        s = ClusteringEvaluator(featuresCol=features, predictionCol="cluster").evaluate(model.transform(df))
        scores.append((k, float(s)))
        if best is None or s > best[0]:
            best = (s, model)
    if best is None:
        raise ValueError("fewer rows than the smallest k")
    return best[1].transform(df), df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def pca_2d(df: DataFrame, features: str = "features") -> DataFrame:
    """Adds x and y: a linear stand-in for a neighbour embedding."""
    v = PCA(k=2, inputCol=features, outputCol="_pca").fit(df).transform(df).withColumn("_xy", vector_to_array("_pca"))
    return v.withColumns({"x": F.get("_xy", F.lit(0)), "y": F.get("_xy", F.lit(1))}).drop("_pca", "_xy")


def settled(*rows: DataFrame) -> DataFrame:
    """Tables of a few rows, computed now, so that what they were computed from can be released."""
    return rows[0].sparkSession.createDataFrame([r for d in rows for r in d.collect()], rows[0].schema)


def importances(model, names: list[str], most: int = 20) -> DataFrame | None:
    """place, feature, importance: the most important inputs of a tree model, ties by place; None where a model has none."""
    found = getattr(model, "featureImportances", None)
    if found is None:
        return None
    values = sorted(((float(v), i) for i, v in enumerate(found.toArray())), key=lambda x: (-x[0], x[1]))[:most]
    rows = [(k + 1, names[i] if i < len(names) else f"f{i}", v) for k, (v, i) in enumerate(values)]
    return SparkSession.active().createDataFrame(rows, "place int, feature string, importance double")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: n / (classes * class size)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    sized = n.withColumn("weight", F.sum("_c").over(W.partitionBy()) / (F.count(F.lit(1)).over(W.partitionBy()) * F.col("_c"))).drop("_c")
    return df.join(F.broadcast(sized), label)  # one row a class


def classifiers(classes: int, width: int, dense: bool = True, seed: int = 42) -> dict:
    common = {"featuresCol": "scaled", "labelCol": "y"}
    out = {
        "logistic_regression": LogisticRegression(weightCol="weight", maxIter=50, **common),
        "random_forest": RandomForestClassifier(numTrees=40, maxDepth=8, seed=seed, **common),
    }
    if dense:
        out["mlp"] = MultilayerPerceptronClassifier(layers=[width, 64, 32, classes], maxIter=50, seed=seed, **common)
    gbt = GBTClassifier(maxIter=15, maxDepth=4, seed=seed, **common)
    out["boosted_trees"] = gbt if classes == 2 else OneVsRest(classifier=gbt, parallelism=2, **common)
    return out


def trained(df: DataFrame, label: str, features: str = "features", only: list[str] | None = None) -> DataFrame:
    """model, accuracy, macro_f1 on the test rows (is_test), labels encoded alphabetically, features standardised on training rows."""
    train, test = df.where("NOT is_test"), df.where("is_test")
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    scale = StandardScaler(inputCol=features, outputCol="scaled", withMean=True)
    ready = Pipeline(stages=[index, scale]).fit(train)
    train, test = balanced(ready.transform(train), "y").cache(), ready.transform(test).cache()
    try:
        width = len(train.select(features).first()[0])
        rows = []
        for name, estimator in classifiers(len(index.labels), width).items():
            if only and name not in only:
                continue
            scored = estimator.fit(train).transform(test).select("y", "prediction")
            rows.append(settled(metrics.multiclass(scored, "y", "prediction").select(F.lit(name).alias("model"), "accuracy", "macro_f1")))
        return settled(*rows)
    finally:
        train.unpersist(), test.unpersist()


def trained_binary(df: DataFrame, label: str, features: str = "features", seed: int = 42, only: list[str] | None = None) -> DataFrame:
    """model, target and the binary and ranking metrics on the test rows; only limits the models by name."""
    rows = df.withColumn("y", F.coalesce(F.col(label), F.lit(False)).cast("int").cast("double")).withColumnRenamed(features, "scaled")
    train, test = balanced(rows.where("NOT is_test"), "y").cache(), rows.where("is_test").cache()
    models = {
        "logistic_regression": LogisticRegression(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=50),
        "random_forest": RandomForestClassifier(featuresCol="scaled", labelCol="y", numTrees=40, seed=seed),
        "boosted_trees": GBTClassifier(featuresCol="scaled", labelCol="y", weightCol="weight", maxIter=15, maxDepth=4, seed=seed),
    }
    try:
        out = []
        for name in (n for n in models if not only or n in only):
            s = models[name].fit(train).transform(test).select("y", "prediction", F.get(vector_to_array("probability"), F.lit(1)).alias("p"))
            row = metrics.binary(s, "y", "prediction").crossJoin(metrics.ranking(s, "y", "p"))  # one row each
            out.append(settled(row.select(F.lit(name).alias("model"), F.lit(label).alias("target"), "*")))
        return settled(*out)
    finally:
        train.unpersist(), test.unpersist()


def trained_regression(df: DataFrame, target: str, features: str = "features", seed: int = 42) -> DataFrame:
    """model, target, mae, rmse, r2 of log1p(target) on the test rows."""
    rows = df.withColumn("y", F.log1p(F.coalesce(F.col(target).cast("double"), F.lit(0.0))))
    train, test = rows.where("NOT is_test").cache(), rows.where("is_test").cache()
    models = {
        "linear": LinearRegression(featuresCol=features, labelCol="y", regParam=0.01),
        "random_forest": RandomForestRegressor(featuresCol=features, labelCol="y", numTrees=30, seed=seed),
        "boosted_trees": GBTRegressor(featuresCol=features, labelCol="y", maxIter=15, maxDepth=4, seed=seed),
    }
    try:
        out = []
        for name, m in models.items():
            row = metrics.regression(m.fit(train).transform(test), "y", "prediction")
            out.append(settled(row.select(F.lit(name).alias("model"), F.lit(target).alias("target"), "mae", "rmse", "r2")))
        return settled(*out)
    finally:
        train.unpersist(), test.unpersist()


def cross_validated(df: DataFrame, label: str, representations: dict[str, str], models: list[str] | None = None) -> DataFrame:
    """fold, representation, model, accuracy, macro_f1: the same folds for every representation."""
    folds = [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]
    out = None
    for f in folds:
        for name, features in representations.items():
            scored = trained(df.withColumn("is_test", F.col("fold") == f), label, features, models or ["logistic_regression"])
            row = scored.select(F.lit(f).alias("fold"), F.lit(name).alias("representation"), "*")
            out = row if out is None else out.unionByName(row)
    return out
