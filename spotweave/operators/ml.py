"""Classifiers and components with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def random_forest(train: DataFrame, rows: DataFrame, features: list[str], label: str, trees: int = 30, seed: int = 42) -> DataFrame:
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)]).fit(train)
    out = model.transform(rows)
    return out.select(*rows.columns, F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("p1"))


def logistic(train: DataFrame, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Balanced by class weights."""
    n = train.groupBy(label).agg(F.count("*").alias("_n"))
    weighed = train.join(F.broadcast(n), label).withColumn("_w", 1.0 / F.col("_n"))  # one row a class
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="_w")]
    return Pipeline(stages=stages).fit(weighed).transform(rows).select(*rows.columns, F.col("prediction").cast("int").alias("predicted"))


def principal_components(rows: DataFrame, features: list[str], k: int = 2, share: float = 0.999) -> DataFrame:
    """First components of standardised features, and whether a row is farther out than `share` of all."""
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True), PCA(k=k, inputCol="scaled", outputCol="pca")]
    out = Pipeline(stages=stages).fit(rows).transform(rows).withColumn("_pc", vector_to_array("pca"))
    out = out.select(*rows.columns, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)])
    far = out.withColumn("distance", F.sqrt(sum(F.col(f"pc{i + 1}") ** 2 for i in range(k))))
    limit = far.agg(F.percentile_approx("distance", share, 100_000).alias("limit"))
    return far.join(F.broadcast(limit)).withColumn("outlier", F.col("distance") > F.col("limit")).drop("limit")  # limit is one row
