"""Two-stage (hurdle) random forests, out-of-fold routing and feature screening."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def forest_pair(train: DataFrame, features: list[str], label: str, target: str, trees: int = 100, seed: int = 42, depth: int = 20) -> tuple:
    """(classifier, regressor): whether there is canopy at all, and how much."""
    train = train.persist(StorageLevel.DISK_ONLY)  # read once for two forests
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    clf = RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed, predictionCol="clf", probabilityCol="clf_p", rawPredictionCol="clf_r")
    rgr = RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=5, featureSubsetStrategy="all", seed=seed, predictionCol="rgr")
    models = Pipeline(stages=[ready, clf]).fit(train), Pipeline(stages=[ready, rgr]).fit(train)
    train.unpersist()
    return models


def save_pair(models: tuple, path: str) -> None:
    """Both models under ``path``, in Spark ML's format; what was there is replaced."""
    for model, name in zip(models, ("clf", "rgr")):
        model.write().overwrite().save(f"{path}/{name}")


def load_pair(path: str) -> tuple:
    return PipelineModel.load(f"{path}/clf"), PipelineModel.load(f"{path}/rgr")


def hurdle(valid: Column, clf: Column, rgr: Column) -> Column:
    """NULL where invalid, 0 where the classifier says none, else the regressor's value."""
    return F.when(~valid, None).when(clf == 0, 0.0).otherwise(rgr)


def predict(df: DataFrame, models: tuple, features: list[str]) -> DataFrame:
    """``df``'s complete rows with clf, clf_prob, rgr and the hurdle prediction."""
    clf, rgr = models
    complete = df.na.drop("any", subset=features)
    out = rgr.transform(clf.transform(complete).drop("features")).drop("features", "clf_r")
    out = out.withColumn("clf_prob", vector_to_array("clf_p")[1]).drop("clf_p")
    return out.withColumn("pred", hurdle(F.lit(True), F.col("clf"), F.col("rgr")))


def out_of_fold(df: DataFrame, features: list[str], label: str, target: str, k: int, trees: int = 20, seed: int = 42, depth: int = 20) -> DataFrame:
    """Each row predicted by the models that did not see its fold; rows without a fold have no prediction."""
    out = None
    for fold in range(k):
        models = forest_pair(df.where(f"fold IS NOT NULL AND fold <> {fold}"), features, label, target, trees, seed, depth)
        part = predict(df.where(f"fold = {fold}"), models, features)
        out = part if out is None else out.unionByName(part)
    return out.unionByName(df.where("fold IS NULL").withColumn("pred", F.lit(None).cast("double")), allowMissingColumns=True)


def importances(models: tuple, features: list[str]) -> list[tuple[str, float, float]]:
    """(feature, classifier's, regressor's) impurity importances; they stand in for mean absolute SHAP values."""
    c, r = models[0].stages[-1].featureImportances.toArray(), models[1].stages[-1].featureImportances.toArray()
    return sorted(zip(features, c.tolist(), r.tolist()), key=lambda x: (-x[1], x[0]))


def correlation_table(df: DataFrame, features: list[str]) -> np.ndarray:
    """Spearman correlations: features x features, whatever the number of rows."""
    packed = VectorAssembler(inputCols=features, outputCol="v", handleInvalid="skip").transform(df).select("v")
    return Correlation.corr(packed, "v", "spearman").first()[0].toArray()


def representatives(corr: np.ndarray, features: list[str], strength: list[float], threshold: float = 0.15) -> list[str]:
    """One feature per cluster of Ward linkage on 1 - |rho| cut at ``threshold``: the strongest, ties to the first."""
    n = len(features)
    d = 1 - np.abs(corr)
    members, size = {i: [i] for i in range(n)}, dict.fromkeys(range(n), 1)
    dist = {(i, j): float(d[i, j]) for i in range(n) for j in range(i + 1, n)}
    while len(members) > 1:
        (i, j), low = min(dist.items(), key=lambda kv: (kv[1], kv[0]))
        if low > threshold:
            break
        for k in members:
            if k in (i, j):
                continue
            a, b = dist.pop((min(i, k), max(i, k))), dist.pop((min(j, k), max(j, k)))
            t = size[i] + size[j] + size[k]
            dist[min(i, k), max(i, k)] = float(np.sqrt(max(((size[i] + size[k]) * a * a + (size[j] + size[k]) * b * b - size[k] * low * low) / t, 0.0)))
        del dist[i, j]
        members[i] += members.pop(j)
        size[i] += size.pop(j)
    return [features[max(m, key=lambda f: (strength[f], -f))] for m in sorted(members.values(), key=min)]


def drop_correlated(corr: np.ndarray, features: list[str], strength: list[float], limit: float = 0.7) -> list[str]:
    """Features left after dropping the weaker of each pair above ``limit``, in the features' order.

    Pairs are settled in the order of the table; one that has lost a member already is no pair any more.
    """
    kept = np.ones(len(features), bool)
    for pair in np.argwhere(np.triu(np.abs(corr) > limit, 1)):
        if kept[pair].all():
            one, other = pair
            kept[one if strength[one] < strength[other] else other] = False
    return [f for f, stays in zip(features, kept) if stays]
