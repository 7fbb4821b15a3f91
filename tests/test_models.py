from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from torqueline.operators import ml
from torqueline.operators.iforest import IsolationForest, average_path, isolation_forest_score
from torqueline.operators.impute import IterativeImputer
from torqueline.operators.rbf import rbf_outlier_flag


@pytest.fixture(scope="module")
def cloud(spark):
    """Gaussian cloud with ten far points, ids 0-9."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 3))
    x[:10] = rng.choice([-1, 1], size=(10, 3)) * 9
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double").persist()


def test_imputer_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=1500), rng.normal(size=1500)
    full = np.column_stack([a, b, 2 * a - b + 1])
    holes = rng.random(full.shape) < 0.2
    holes[holes.sum(axis=1) > 1] = False  # one gap per row can be recovered exactly
    rows = [(i, *[None if h else float(v) for v, h in zip(r, hs)]) for i, (r, hs) in enumerate(zip(full, holes))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    model = IterativeImputer(["a", "b", "c"], rounds=20, tol=1e-6).fit(df)
    got = np.array([list(r)[1:] for r in model.transform(df).orderBy("id").collect()])
    assert np.abs(got - full)[holes].max() < 0.02
    assert (got[~holes] == full[~holes]).all()


def test_imputer_matches_plain_chained_regression(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    x[rng.random(x.shape) < np.array([0.05, 0.2, 0.1, 0.0])] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)],
                               "id int, a double, b double, c double, d double")
    got = np.array([list(r)[1:] for r in IterativeImputer(["a", "b", "c", "d"], rounds=3, tol=0).fit(df).transform(df)
                    .orderBy("id").collect()])
    gap = np.isnan(x)
    want = np.where(gap, np.nanmean(x, axis=0), x)
    for _ in range(3):
        for j in sorted(range(4), key=lambda j: gap[:, j].sum()):
            if gap[:, j].any():
                others = [k for k in range(4) if k != j]
                design = np.column_stack([np.ones(300), want[:, others]])
                beta = np.linalg.lstsq(design[~gap[:, j]], want[~gap[:, j], j], rcond=None)[0]
                want[gap[:, j], j] = design[gap[:, j]] @ beta
    assert np.allclose(got, want, atol=1e-8)


def test_imputer_without_gaps(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    assert IterativeImputer(["a", "b"]).fit(df).transform(df).collect() == df.collect()


def test_forest_ranks_far_points_first(cloud):
    model = IsolationForest(["a", "b", "c"], ["id"], trees=50).fit(cloud)
    top = {r["id"] for r in model.score(cloud).orderBy(F.desc("AnomalyScore")).limit(10).collect()}
    assert top == set(range(10))
    flags = {r["anomaly"]: r["count"] for r in model.flag(cloud, cloud, 0.1).groupBy("anomaly").count().collect()}
    assert flags == {-1: 200, 1: 1800}


def test_forest_is_the_same_under_repartition(cloud):
    one = IsolationForest(["a", "b", "c"], ["id"], trees=20).fit(cloud)
    two = IsolationForest(["a", "b", "c"], ["id"], trees=20).fit(cloud.repartition(7))
    assert (one.feature == two.feature).all() and np.allclose(one.cut, two.cut)


def test_forest_with_fewer_rows_than_samples(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)] + [(99, 500.0)], "id int, x double")
    out = isolation_forest_score(df, ["x"], ["id"], trees=30).orderBy(F.desc("MaintenanceNeed_IF")).collect()
    assert out[0]["id"] == 99 and out[0]["MaintenanceNeed_IF"] == 100.0 and out[-1]["MaintenanceNeed_IF"] == 0.0


def test_average_path():
    assert average_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_kernel_flag_finds_far_points(cloud):
    out = rbf_outlier_flag(cloud, ["a", "b", "c"], nu=0.005, gamma=0.05, features=256)
    assert {r["id"] for r in out.filter("outlier = -1").collect()} == set(range(10))


def test_pca_and_outlier_flag(spark):
    rng = np.random.default_rng(1)
    t = rng.normal(size=500)
    df = spark.createDataFrame([(float(v), float(2 * v + e)) for v, e in zip(t, rng.normal(scale=0.01, size=500))], "a double, b double")
    out = ml.pca_outlier_flag(ml.pca_project(df, ["a", "b"]), 3, 3).toPandas()
    assert out["PC1"].var() == pytest.approx(2.0, abs=0.01) and out["PC2"].abs().max() < 0.1
    assert np.corrcoef(out["PC1"], out["a"])[0, 1] > 0.99
    assert (out["pca_outlier"] == (out["PC1"].abs() > 3)).all()


def test_split_is_stable(spark):
    df = spark.range(10_000)
    train, test = ml.train_test_split(df, ["id"])
    assert abs(test.count() - 2000) < 150 and train.count() + test.count() == 10_000
    again = ml.train_test_split(df.repartition(5), ["id"])[1]
    assert {r[0] for r in test.collect()} == {r[0] for r in again.collect()}


def test_classifiers_learn_and_survive_saving(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(600, 2))
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 1)) for i, (a, b) in enumerate(x)], "id int, a double, b double, y int")
    models = {
        "forest": ml.random_forest_classifier(df, ["a", "b"], "y", trees=10, depth=5),
        "boosted": ml.boosted_tree_classifier(df, ["a", "b"], "y", rounds=5, depth=3),
        "logistic": ml.logistic_regression(df, ["a", "b"], "y"),
    }
    table = ml.compare_models({n: ml.predict(m, df) for n, m in models.items()}, "y").collect()
    assert all(r["accuracy"] > 0.9 for r in table)
    ml.save_model(models["forest"], str(tmp_path / "m"))
    assert ml.predict(ml.load_model(str(tmp_path / "m")), df).collect() == ml.predict(models["forest"], df).collect()
    assert ml.feature_importance_topk(models["forest"], ["a", "b"], df, 1).count() == 1
    assert ml.score_auc(models["logistic"], df, "y") > 0.95


def test_agreement_scores(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("b", 1), ("b", 0), (None, 2)], "l string, c int")
    assert ml.adjusted_rand_index(df, "l", "l").first()[0] == pytest.approx(1.0)
    assert ml.normalized_mutual_info(df, "l", "l").first()[0] == pytest.approx(1.0)
    # by hand: pairs kept together 1 + 1, per side 1 + 3 and 3 + 1, of 15
    assert ml.adjusted_rand_index(df, "l", "c").first()[0] == pytest.approx((2 - 16 / 15) / (4 - 16 / 15))


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "y double, p double")
    row = ml.regression_metrics(df, "y", "p").first()
    assert (row["rmse"], row["r2"]) == (pytest.approx(0.5 ** 0.5), pytest.approx(0.5))


def test_own_models_are_saved_and_loaded(spark, cloud, tmp_path):
    forest = IsolationForest(["a", "b", "c"], ["id"], trees=5).fit(cloud)
    forest.save(spark, str(tmp_path / "forest"))
    again = type(forest).load(spark, str(tmp_path / "forest"))
    assert again.score(cloud).orderBy("id").collect() == forest.score(cloud).orderBy("id").collect()
    gappy = cloud.selectExpr("id", "IF(id % 5 = 0, NULL, a) AS a", "b", "IF(id % 7 = 0, NULL, c) AS c")
    imputer = IterativeImputer(["a", "b", "c"]).fit(gappy)
    imputer.save(spark, str(tmp_path / "imputer"))
    assert type(imputer).load(spark, str(tmp_path / "imputer")) == imputer
