"""Models (M5-M7, M9, M12).

MLlib estimators run distributed on a vector column; the isolation forest
(absent from MLlib) is in ``iforest``.

Substitutions (stated): Ward agglomerative clustering -> ``BisectingKMeans``
(divisive; Ward's O(n^2) linkage has no distributed form); scikit-learn's
random generators -> Spark seeds and hash-driven sampling, so rows differ and
metrics are compared, not labels.
"""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def random_forest(train: DataFrame, test: DataFrame, label: str, trees: int = 100, seed: int = 42):
    """M5: 100 trees; returns (predictions on test, importances DataFrame)."""
    m = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, seed=seed).fit(train)
    return m.transform(test), m.featureImportances


def decision_tree(train: DataFrame, test: DataFrame, label: str, weight: str, depth: int = 4, seed: int = 42):
    """M6: depth-4 tree with balanced class weights; returns (predictions, rules text)."""
    m = DecisionTreeClassifier(labelCol=label, featuresCol="features", maxDepth=depth, weightCol=weight,
                               seed=seed).fit(train)
    return m.transform(test), m.toDebugString


def kmeans(df: DataFrame, k: int = 3, seed: int = 42, col: str = "kmeans") -> DataFrame:
    """M7."""
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol=col).fit(df).transform(df)


def kmeans_centres(df: DataFrame, k: int = 3, seed: int = 42, col: str = "kmeans") -> tuple[DataFrame, list]:
    """M7 with its centres."""
    m = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=col).fit(df)
    return m.transform(df), m.clusterCenters()


def bisecting(df: DataFrame, k: int = 3, seed: int = 42, col: str = "hierarchical") -> DataFrame:
    """M9 (substitute for Ward)."""
    return BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol=col).fit(df).transform(df)


def pca2(df: DataFrame, centered: str = "features") -> tuple[DataFrame, list[float], list[list[float]]]:
    """Projection on two components of the centred features (MLlib does not centre), their share of the
    variance and their loadings (one list a component; the sign is fixed by the largest loading being positive)."""
    m = PCA(k=2, inputCol=centered, outputCol="pca").fit(df)
    loadings = m.pc.toArray().T
    signs = [1.0 if v[abs(v).argmax()] > 0 else -1.0 for v in loadings]
    return m.transform(df), [float(x) for x in m.explainedVariance], [[float(x) * g for x in v] for v, g in zip(loadings, signs, strict=True)]
