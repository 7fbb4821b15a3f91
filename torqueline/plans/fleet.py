"""Fleet set: imputation, maintenance scores and their model: K6-K9, K14."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import pair_mean, to_number
from torqueline.operators.columns import all_null_columns
from torqueline.operators.iforest import isolation_forest_score
from torqueline.operators.impute import IterativeImputer
from torqueline.operators.ml import (
    boosted_tree_regressor, pca_outlier_flag, pca_project, predict, random_forest_regressor, regression_metrics,
    save_model, train_test_split,
)
from torqueline.operators.profile import histogram, quantile_table
from torqueline.operators.rows import drop_rows_missing_over_n, mask_filter
from torqueline.operators.scaling import add_stress, add_weighted_index, cap_at_quantile
from torqueline.operators.trees import TreeEnsemble
from torqueline.schema import FLEET_SIGNALS
from torqueline.session import settle

# Columns left out before imputation.
UNUSED = ["road_type", "traffic_condition", "FUEL_PRESSURE"]

# Stress columns, their inputs and weights.
UPPER_STRESS = {
    "Stress_ENGINE_LOAD": "ENGINE_LOAD",
    "Stress_COOLANT_TEMP": "COOLANT_TEMP",
    "Stress_AIRFLOW": "AIRFLOW_CAPPED_NORM",
}
TWO_SIDED_STRESS = {
    "Stress_SHORT_FUEL_TRIM_1": "SHORT_FUEL_TRIM_1",
    "Stress_TIMING_ADVANCE": "TIMING_ADVANCE",
    "Stress_O2_COMBO": "O2_COMBO",
}
WEIGHTS = {
    "Stress_ENGINE_LOAD": 0.25,
    "Stress_COOLANT_TEMP": 0.20,
    "Stress_AIRFLOW": 0.15,
    "Stress_SHORT_FUEL_TRIM_1": 0.10,
    "Stress_TIMING_ADVANCE": 0.10,
    "Stress_O2_COMBO": 0.20,
}
# The variant that also looks at air mass flow.
WEIGHTS_WITH_MAF = {**WEIGHTS, "Stress_MAF": 0.15, "Stress_O2_COMBO": 0.05}

# Inputs of the anomaly score.
ANOMALY_FEATURES = [
    "ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_CAPPED_NORM", "SHORT_FUEL_TRIM_1", "TIMING_ADVANCE", "O2_COMBO",
]


def impute_fleet(df: DataFrame, cols: Sequence[str] = FLEET_SIGNALS, most_missing: int = 4, rounds: int = 10) -> DataFrame:
    """Drop rows with many gaps, then fill the sensors from each other."""
    df = drop_rows_missing_over_n(df, most_missing).drop(*UNUSED)
    kinds = dict(df.dtypes)
    cols = [c for c in cols if c in df.columns]
    df = df.withColumns({c: to_number(c) if kinds[c] == "string" else F.col(c).cast("double") for c in cols})
    empty = all_null_columns(df, cols)
    return IterativeImputer([c for c in cols if c not in empty], rounds).fit(df).transform(df)


def prepare_scores(df: DataFrame, numeric: Sequence[str] = FLEET_SIGNALS, drop_outliers: bool = False,
                   drop_maf: bool = True) -> DataFrame:
    """Capped airflow, optional removal of far rows, combined oxygen sensors."""
    df = cap_at_quantile(df, "AIRFLOW_PER_RPM", "AIRFLOW_CAPPED", 0.99, scaled="AIRFLOW_CAPPED_NORM")
    if drop_outliers:
        flagged = pca_outlier_flag(pca_project(df, [c for c in numeric if c in df.columns]), 5, 10)
        df = mask_filter(flagged, "pca_outlier").drop("PC1", "PC2", "pca_outlier")
    df = df.withColumn("O2_COMBO", pair_mean("O2_B1S2", "O2_B2S2"))
    return df.drop("MAF") if drop_maf else df


def rule_maintenance_need(df: DataFrame, with_maf: bool = False, prepared: bool = False,
                          drop_outliers: bool = False) -> DataFrame:
    """Rule-based maintenance need, 0-100, from quantile stress of six (or seven) signals."""
    if not prepared:
        df = prepare_scores(df, drop_outliers=drop_outliers, drop_maf=not with_maf)
    upper = {**UPPER_STRESS, "Stress_MAF": "MAF"} if with_maf else UPPER_STRESS
    df = add_stress(df, upper, TWO_SIDED_STRESS)
    return add_weighted_index(df, WEIGHTS_WITH_MAF if with_maf else WEIGHTS)


def anomaly_maintenance_need(df: DataFrame, key: Sequence[str], features: Sequence[str] = ANOMALY_FEATURES,
                             trees: int = 200, parts: int | None = None) -> DataFrame:
    return isolation_forest_score(df, features, key, trees, parts=parts)


@dataclass(frozen=True)
class TrainedScores:
    forest: TreeEnsemble
    boosted: TreeEnsemble
    metrics: DataFrame


def train_maintenance_model(df: DataFrame, features: Sequence[str], key: Sequence[str],
                            target: str = "MaintenanceNeed_IF", path: str | None = None, trees: int = 200,
                            rounds: int = 200) -> TrainedScores:
    """Two regressors on an explicit feature list, so that no score leaks into its own model."""
    # two fits and two evaluations read it, and a score is dear
    df = settle(df.select(*dict.fromkeys([*key, *features, target])), "scored")
    train, test = train_test_split(df, key)
    models = {
        "random_forest": random_forest_regressor(train, features, target, trees),
        "boosted_trees": boosted_tree_regressor(train, features, target, rounds),
    }
    metrics = None
    for name, model in models.items():
        row = regression_metrics(predict(model, test), target, "prediction").select(F.lit(name).alias("model"), "*")
        metrics = row if metrics is None else metrics.unionAll(row)
        if path:
            save_model(model, f"{path}/{name}")
    return TrainedScores(models["random_forest"], models["boosted_trees"], metrics)


def score_comparison(df: DataFrame, scores: Mapping[str, str], bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Histograms of the scores, stacked, and their quantiles side by side."""
    bars = None
    for name, col in scores.items():
        one = histogram(df, col, bins).select(F.lit(name).alias("score"), "*")
        bars = one if bars is None else bars.unionAll(one)
    return bars, quantile_table(df, scores)
