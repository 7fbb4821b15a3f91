"""Models and their evaluation: M1-M7, M10-M15, M17-M20, S14."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.operators import linear
from torqueline.operators import trees as grown
from torqueline.operators.linear import LogisticModel
from torqueline.operators.trees import TreeEnsemble
from torqueline.sources.sinks import read_json

Model = TreeEnsemble | LogisticModel


def train_test_split(df: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Hash split on the row key: the same rows under any partitioning or retry."""
    draw = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000))
    cut = F.lit(int(round(test_share * 10_000)))
    return df.filter(draw >= cut), df.filter(draw < cut)


def random_forest_classifier(train: DataFrame, features: Sequence[str], label: str, trees: int = 100,
                             depth: int = 10, seed: int = 42, key: Sequence[str] | None = None) -> TreeEnsemble:
    """Root of the number of features tried at a node, rows drawn by a hash of ``key`` (default: all columns)."""
    most = max(1, int(np.sqrt(len(features))))
    return grown.forest(train, features, label, "share", trees, depth, most, seed=seed, key=key)


def boosted_tree_classifier(train: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 6,
                            step: float = 0.3) -> TreeEnsemble:
    return grown.boosted(train, features, label, "logistic", rounds, depth, step)


def logistic_regression(train: DataFrame, features: Sequence[str], label: str, iterations: int = 1000) -> LogisticModel:
    """L2 with unit strength on the summed loss."""
    return linear.fit_logistic(train, features, label, 1.0, iterations)


def random_forest_regressor(train: DataFrame, features: Sequence[str], target: str, trees: int = 200, depth: int = 10,
                            seed: int = 42, key: Sequence[str] | None = None) -> TreeEnsemble:
    return grown.forest(train, features, target, "value", trees, depth, seed=seed, key=key)


def boosted_tree_regressor(train: DataFrame, features: Sequence[str], target: str, rounds: int = 200, depth: int = 6,
                           step: float = 0.1) -> TreeEnsemble:
    return grown.boosted(train, features, target, "value", rounds, depth, step)


def tte_regressor(train: DataFrame, features: Sequence[str], target: str = "tte", rounds: int = 100, depth: int = 3,
                  step: float = 0.1) -> TreeEnsemble:
    """Time-to-event by gradient boosting with the usual small trees."""
    return boosted_tree_regressor(train, features, target, rounds, depth, step)


def predict(model: Model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("rawPrediction")


def score_auc(model: Model, df: DataFrame, label: str) -> float:
    """Area under the curve from scores rather than hard labels."""
    return BinaryClassificationEvaluator(labelCol=label).evaluate(model.transform(df))


def feature_importance_topk(model: TreeEnsemble, features: Sequence[str], df: DataFrame, k: int = 15) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(features, model.importances())]
    return df.sparkSession.createDataFrame(rows, "column string, importance double").orderBy(
        F.desc("importance"), "column").limit(k)


def save_model(model: Model, path: str) -> None:
    model.save(SparkSession.active(), path)


def load_model(path: str) -> Model:
    spark = SparkSession.active()
    return (LogisticModel if "weights" in read_json(spark, path) else TreeEnsemble).load(spark, path)


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class; a ratio without cases is 0."""
    cells = confusion_matrix(df, label, prediction)
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(zero)
    sides = F.explode(F.array(
        F.struct(F.col("actual").cast("double").alias("class"), F.col("n").alias("support"), hit.alias("hits"),
                 zero.alias("claimed")),
        F.struct(F.col("predicted").cast("double").alias("class"), zero.alias("support"), zero.alias("hits"),
                 F.col("n").alias("claimed")),
    ))
    sums = cells.select(sides.alias("s")).select("s.*").groupBy("class").agg(
        F.sum("hits").alias("hits"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.select(
        "class", ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("claimed") + F.col("support")).alias("f1"), "support",
    )


def evaluate_classifier(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, area under the curve from hard 0/1 labels, and F1 of class 1."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.select(
        F.try_divide(tp + tn, F.col("n")).alias("accuracy"),
        ((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("auc"),
        F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
    )


def compare_models(scored: Mapping[str, DataFrame], label: str, prediction: str = "prediction") -> DataFrame:
    rows = [evaluate_classifier(df, label, prediction).select(F.lit(name).alias("model"), "*")
            for name, df in scored.items()]
    return reduce(DataFrame.unionAll, rows)


def pca_project(df: DataFrame, cols: Sequence[str], k: int = 2, scaled: bool = True, prefix: str = "PC") -> DataFrame:
    """First ``k`` principal components as columns; signs fixed so the largest loading is positive."""
    mean, scale, loadings = linear.principal_components(df, cols, k, scaled)
    out = {}
    for i in range(k):
        terms = [(F.col(f"`{c}`").cast("double") - F.lit(float(mean[j]))) * F.lit(float(loadings[j, i] / scale[j])) for j, c in enumerate(cols)]
        out[f"{prefix}{i + 1}"] = reduce(lambda a, b: a + b, terms)
    return df.withColumns(out)


def pca_outlier_flag(df: DataFrame, first: float = 3, second: float = 3, out: str = "pca_outlier") -> DataFrame:
    """Flag by raw component scores (not deviations); limits (3, 3) to count, (5, 10) to drop."""
    return df.withColumn(out, (F.abs("PC1") > first) | (F.abs("PC2") > second))


def kmeans_cluster(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, out: str = "cluster", rounds: int = 100,
                   start: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """Clusters numbered in the order of their centres; ``start`` gives the first centres."""
    return linear.with_cluster(df, cols, linear.fit_kmeans(df, cols, k, seed, rounds, start=start), out)


def silhouette(clustered: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Rows and mean silhouette with squared Euclidean distance, linear in rows."""
    return linear.silhouette(clustered, cols, cluster)


def _contingency_levels(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the pairs, of each side and of all rows; ``level`` 0, 1 (a), 2 (b), 3."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return cells.cube("a", "b").agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    levels = _contingency_levels(df, a, b)
    n = F.col("n").cast("double")
    pairs = n * (n - 1) / 2

    def at(level: int) -> Column:
        return F.sum(F.when(F.col("level") == level, pairs).otherwise(0.0))

    s = levels.agg(at(0).alias("both"), at(1).alias("a"), at(2).alias("b"), at(3).alias("all"))
    chance = F.try_divide(F.col("a") * F.col("b"), F.col("all"))
    most = (F.col("a") + F.col("b")) / 2
    return s.select(F.coalesce(F.try_divide(F.col("both") - chance, most - chance), F.lit(1.0)).alias("ari"))


def normalized_mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean entropy; two one-class sides agree fully."""
    levels = _contingency_levels(df, a, b)
    n = F.col("n").cast("double")

    def at(level: int, what: Column) -> Column:
        return F.sum(F.when(F.col("level") == level, what).otherwise(0.0))

    s = levels.agg(at(3, n).alias("n"), *[at(i, n * F.ln(n)).alias(f"s{i}") for i in range(3)])
    h = [F.ln("n") - F.try_divide(F.col(f"s{i}"), F.col("n")) for i in range(3)]
    score = F.try_divide(h[1] + h[2] - h[0], (h[1] + h[2]) / 2)
    return s.select(F.coalesce(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("nmi"))


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.agg(
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y))).alias("r2"),
    )
