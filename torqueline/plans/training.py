"""Labelled training tables: K12 vehicle maintenance, K13 truck component, model comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import days_since, days_until
from torqueline.functions.text import map_values
from torqueline.operators.columns import drop_columns_null_count, numeric_columns, text_columns
from torqueline.operators.encode import label_encode, one_hot_drop_first
from torqueline.operators.joins import inner_equi_join
from torqueline.operators.ml import (
    Model, boosted_tree_classifier, compare_models, feature_importance_topk, logistic_regression, predict,
    random_forest_classifier, train_test_split,
)
from torqueline.operators.profile import chi2_scores, point_biserial
from torqueline.operators.scaling import fill, moments, standardise
from torqueline.session import settle

# Ranks of the categories of the vehicle-maintenance table.
CATEGORY_RANKS = {
    "Vehicle_Model": {"Truck": 0, "Van": 1, "Bus": 2},
    "Maintenance_History": {"Poor": 0, "Average": 1, "Good": 2},
    "Fuel_Type": {"Petrol": 0, "Electric": 1},
    "Transmission_Type": {"Manual": 0, "Automatic": 1},
    "Owner_Type": {"First": 0, "Second": 1, "Third": 2},
    "Tire_Condition": {"Worn Out": 0, "Good": 1, "New": 2},
    "Brake_Condition": {"Worn Out": 0, "Good": 1, "New": 2},
    "Battery_Status": {"Weak": 0, "Good": 1, "New": 2},
}
# Categories that become 0/1 columns.
ONE_HOT = [
    "Vehicle_Model", "Maintenance_History", "Fuel_Type", "Transmission_Type", "Owner_Type", "Service_History",
    "Accident_History", "Tire_Condition", "Brake_Condition", "Battery_Status",
]
# Kinds of work in the car-maintenance table, and the engine table's new names.
WORK_KINDS = {"Repair": 0, "Routine Maintenance": 1, "Component Replacement": 2}
ENGINE_NAMES = {
    "Engine rpm": "Engine_RPM",
    "Lub oil pressure": "Lub_Oil_Pressure",
    "Fuel pressure": "Fuel_Pressure",
    "Coolant pressure": "Coolant_Pressure",
    "lub oil temp": "Lub_Oil_Temp",
    "Coolant temp": "Coolant_Temp",
    "Engine Condition": "Engine_Condition",
}
# Columns of the truck table that are no features.
TRUCK_NOT_FEATURES = ["in_study_repair", "tte", "vehicle_id", "timestamp"]


def maintenance_features(df: DataFrame, as_of: date | datetime, ranks: Mapping = CATEGORY_RANKS,
                         one_hot: Sequence[str] = ONE_HOT, last: str = "Last_Service_Date",
                         until: str = "Warranty_Expiry_Date") -> DataFrame:
    """Ranks of categories, day counts and 0/1 columns of the vehicle-maintenance table."""
    df = df.withColumns({c: map_values(c, m) for c, m in ranks.items() if c in df.columns})
    df = df.withColumns({
        "Days_Since_Last_Service": days_since(last, as_of), "Days_Until_Warranty_Expiry": days_until(until, as_of),
    })
    return one_hot_drop_first(df, [c for c in one_hot if c in df.columns]).drop(last, until)


def feature_report(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Point-biserial correlation and chi-square score of each feature."""
    return point_biserial(df, features, label).join(chi2_scores(df, features, label), "column")


def train_classifiers(train: DataFrame, features: Sequence[str], label: str, trees: int = 100,
                      rounds: int = 100) -> dict[str, Model]:
    return {
        "random_forest": random_forest_classifier(train, features, label, trees),
        "boosted_trees": boosted_tree_classifier(train, features, label, rounds),
        "logistic_regression": logistic_regression(train, features, label),
    }


def classifier_comparison(df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], trees: int = 100,
                          rounds: int = 100) -> DataFrame:
    """Held-out accuracy, area under the curve and F1 of the three classifiers."""
    train, test = train_test_split(df.select(*dict.fromkeys([*key, *features, label])), key)
    models = train_classifiers(train, features, label, trees, rounds)
    return compare_models({name: predict(m, test) for name, m in models.items()}, label)


def truck_table(readouts: DataFrame, specifications: DataFrame, tte: DataFrame, key: str = "vehicle_id",
                most_missing: int = 5000) -> DataFrame:
    """Three files joined, sparse columns dropped, gaps filled with means, text encoded."""
    # three statistics jobs follow: join once
    df = settle(inner_equi_join(inner_equi_join(readouts, specifications, key), tte, key), "truck")
    df = drop_columns_null_count(df, most_missing)
    df = fill(df, numeric_columns(df), "mean")
    return label_encode(df, text_columns(df))


def truck_component(df: DataFrame, key: Sequence[str], label: str = "in_study_repair",
                    not_features: Sequence[str] = TRUCK_NOT_FEATURES, trees: int = 100,
                    k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Importances of a forest fitted on train-scaled features, and label correlations."""
    features = [c for c in numeric_columns(df) if c not in {*not_features, *key, label}]
    train, _ = train_test_split(df, key)
    scaled = standardise(train, features, fitted=moments(train, features))
    model = random_forest_classifier(scaled, features, label, trees)
    return feature_importance_topk(model, features, df, k), point_biserial(df, features, F.col(label))
