from __future__ import annotations

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from torqueline.operators import held, linear, ml, rows, trees


@pytest.fixture(scope="module")
def waves(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(3000, 3)), 2)
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + x[:, 1] ** 2 + rng.normal(scale=0.1, size=len(x))
    gone = rng.random(len(x)) < 0.1
    rows = [(i, None if g else float(a), float(b), float(c), float(v), int(v > 1)) for i, ((a, b, c), v, g) in enumerate(zip(x, y, gone))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, k int").persist()


COLS = ["a", "b", "c"]


def grown_by_hand(x, g, h, depth, penalty, least, cuts):
    """Leaf value of every row of one tree, by plain recursion over all (feature, cut, missing side)."""
    out = np.zeros(len(x))

    def part(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + penalty)

    def split(rows, level):
        best = (1e-9, None)
        if level < depth:
            for j in range(x.shape[1]):
                for cut in cuts[j]:
                    for side in (True, False):
                        v = x[rows, j]
                        left = np.where(np.isnan(v), side, v <= cut)
                        a, b = rows[left], rows[~left]
                        if len(a) and len(b) and h[a].sum() >= least and h[b].sum() >= least:
                            gain = part(a) + part(b) - part(rows)
                            if gain > best[0] + 1e-7:
                                best = (gain, (a, b))
        if best[1] is None:
            out[rows] = -g[rows].sum() / (h[rows].sum() + penalty)
        else:
            split(best[1][0], level + 1)
            split(best[1][1], level + 1)

    split(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("link", ["value", "logistic"])
def test_boosting_equals_brute_force(spark, waves, link):
    target = "y" if link == "value" else "k"
    few = waves.where("id < 300")
    model = trees.boosted(few, COLS, target, link, 4, 3, 0.3, bins=8)
    got = np.array([r["s"] for r in model.score(few, "s").orderBy("id").collect()])
    data = few.orderBy("id").toPandas()
    x, y = data[COLS].to_numpy(float), data[target].to_numpy(float)
    cuts = [np.unique(np.nanquantile(x[:, j], np.arange(1, 8) / 8)) for j in range(3)]
    margin = np.full(len(y), y.mean() if link == "value" else np.log(y.mean() / (1 - y.mean())))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = (margin - y, np.ones(len(y))) if link == "value" else (p - y, p * (1 - p))
        margin += 0.3 * grown_by_hand(x, g, h, 3, 1.0, 1.0, cuts)
    want = margin if link == "value" else 1 / (1 + np.exp(-margin))
    assert np.allclose(got, want, atol=1e-5)


def test_forest_equals_brute_force(spark, waves):
    few = waves.where("id < 300")
    model = trees.forest(few, COLS, "y", "value", 3, 4, bins=8, key=["id"])
    got = np.array([r["s"] for r in model.score(few, "s").orderBy("id").collect()])
    data = few.withColumn("h", trees.row_hash(["id"])).orderBy("id").toPandas()
    x, y = data[COLS].to_numpy(float), data["y"].to_numpy(float)
    cuts = [np.unique(np.nanquantile(x[:, j], np.arange(1, 8) / 8)) for j in range(3)]
    total = np.zeros(len(y))
    for t in range(3):
        w = trees.bootstrap(data["h"].to_numpy(np.int64), t, 42).astype(float)
        drawn = w > 0
        leaf = {tuple(np.nan_to_num(r, nan=-99)): v for r, v in zip(x[drawn], grown_by_hand(x[drawn], -w[drawn] * y[drawn], w[drawn], 4, 0.0, 1.0, cuts))}
        total += np.array([leaf.get(tuple(np.nan_to_num(r, nan=-99)), np.nan) for r in x])
    seen = ~np.isnan(total)
    assert seen.sum() > 50 and np.allclose(got[seen], total[seen] / 3, atol=1e-5)


def test_bootstrap_weights_are_poisson():
    w = trees.bootstrap(np.random.default_rng(0).integers(0, 1 << 60, 200_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)


@pytest.mark.parametrize("fit", [
    lambda d: trees.boosted(d, COLS, "y", "value", 12, 4, 0.2), lambda d: trees.boosted(d, COLS, "k", "logistic", 3, 3, 0.3),
    lambda d: trees.forest(d, COLS, "k", "share", 7, 6, 2), lambda d: trees.forest(d, COLS, "y", "value", 4, 5)])
def test_models_do_not_depend_on_partitions(waves, fit):
    one, two = fit(waves), fit(waves.repartition(7))
    for name in ("feature", "cut", "missing_left", "value", "gain"):
        assert (getattr(one, name) == getattr(two, name)).all()


def test_small_blocks_and_groups_change_nothing(waves, monkeypatch):
    few = waves.where("id < 500")
    one = trees.forest(few, COLS, "y", "value", 5, 5)
    monkeypatch.setattr(trees, "BLOCK", 64)
    monkeypatch.setattr(trees, "CELLS", 300)
    two = trees.forest(few, COLS, "y", "value", 5, 5)
    assert (one.feature == two.feature).all() and (one.value == two.value).all()


def test_models_learn_and_rank_features(waves):
    train, test = ml.train_test_split(waves, ["id"])
    for model in (ml.boosted_tree_regressor(train, COLS, "y", 40, 4), ml.random_forest_regressor(train, COLS, "y", 30, 8)):
        assert ml.regression_metrics(ml.predict(model, test), "y", "prediction").first()["r2"] > 0.8
        assert model.importances().argmin() == 2 and model.importances().sum() == pytest.approx(1)
    for model in (ml.boosted_tree_classifier(train, COLS, "k", 20), ml.random_forest_classifier(train, COLS, "k", 30)):
        assert ml.evaluate_classifier(ml.predict(model, test), "k", "prediction").first()["accuracy"] > 0.85
        assert ml.score_auc(model, test, "k") > 0.9


def test_odd_training_tables(spark):
    schema = "a double, b double, c double, y double"
    flat = spark.createDataFrame([(None, 1.0, float("nan"), 4.0)] * 5, schema)
    for model in (trees.boosted(flat, COLS, "y", "value", 2, 2, 0.3), trees.forest(flat, COLS, "y", "value", 2, 2)):
        assert [round(r["s"], 6) for r in model.score(flat, "s").collect()] == [4.0] * 5 and (model.feature < 0).all()
    some = spark.createDataFrame([(1.0, 1.0, 1.0, None), (2.0, 1.0, 1.0, 3.0), (5.0, 1.0, 1.0, 7.0), (float("inf"), 1.0, 1.0, 7.0)], schema)
    model = trees.boosted(some, COLS, "y", "value", 50, 2, 0.5, least=1.0)
    assert [r["s"] for r in model.score(some.where("a >= 2"), "s").orderBy("a").collect()] == pytest.approx([3, 7, 7], abs=0.05)
    with pytest.raises(ValueError):
        trees.forest(some.where("false"), COLS, "y", "value", 2, 2)
    with pytest.raises(ValueError):
        trees.boosted(some, COLS, "y", "logistic", 2, 2, 0.3)


def test_saved_models_score_alike(spark, waves, tmp_path):
    for i, model in enumerate((trees.forest(waves, COLS, "k", "share", 3, 4), ml.logistic_regression(waves, COLS, "k"))):
        ml.save_model(model, str(tmp_path / str(i)))
        assert ml.predict(ml.load_model(str(tmp_path / str(i))), waves).orderBy("id").collect() == ml.predict(model, waves).orderBy("id").collect()


def test_logistic_gradient_vanishes(waves):
    model = ml.logistic_regression(waves, COLS, "k")
    data = waves.dropna().toPandas()
    x, y = data[COLS].to_numpy(float), data["k"].to_numpy(float)
    p = 1 / (1 + np.exp(-(x @ np.array(model.weights) + model.intercept)))
    assert np.abs(x.T @ (p - y) + np.array(model.weights)).max() < 1e-5 and abs((p - y).sum()) < 1e-5
    again = ml.logistic_regression(waves.repartition(5), COLS, "k")
    assert np.allclose(again.weights, model.weights, atol=1e-9)


def test_components_equal_a_decomposition(waves):
    data = waves.dropna().toPandas()[COLS].to_numpy(float)
    _, _, loadings = linear.principal_components(waves, COLS, 2, True)
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    values, vectors = np.linalg.eigh(np.cov(z.T, ddof=0))
    for i in range(2):
        assert abs(loadings[:, i] @ vectors[:, -1 - i]) == pytest.approx(1, abs=1e-8)


def test_clusters_and_silhouette(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0.0], [5.0, 5.0], [0.0, 9.0]])
    x = np.concatenate([rng.normal(c, 0.4, size=(60, 2)) for c in centres])
    df = spark.createDataFrame([(*map(float, r),) for r in x] + [(None, 1.0)], "a double, b double")
    out = ml.kmeans_cluster(df, ["a", "b"], 3)
    data = out.toPandas()
    assert data["cluster"].isna().sum() == 1
    data = data.dropna()
    assert sorted(data.groupby("cluster").size()) == [60, 60, 60]
    again = ml.kmeans_cluster(df.repartition(6), ["a", "b"], 3).toPandas().dropna()
    assert sorted(map(tuple, again.to_numpy().tolist())) == sorted(map(tuple, data.to_numpy().tolist()))
    points, labels = data[["a", "b"]].to_numpy(), data["cluster"].to_numpy()
    d = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    s = []
    for i in range(len(points)):
        own = d[i][labels == labels[i]].sum() / ((labels == labels[i]).sum() - 1)
        other = min(d[i][labels == c].mean() for c in set(labels) - {labels[i]})
        s.append((other - own) / max(other, own))
    assert ml.silhouette(out, ["a", "b"]).first()["silhouette"] == pytest.approx(np.mean(s), abs=1e-9)
    assert ml.silhouette(out.withColumn("cluster", F.lit(1)), ["a", "b"]).first()["silhouette"] == 0.0


def jobs_of(spark, fit):
    """The model and the number of Spark jobs that its fit took."""
    context = spark.sparkContext
    name = uuid.uuid4().hex
    context.setJobGroup(name, name)
    try:
        return fit(), len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_a_fit_do_not_grow_with_the_trees(spark, waves):
    few, many = (jobs_of(spark, lambda r=r: trees.boosted(waves, COLS, "y", "value", r, 4, 0.2))[1] for r in (1, 12))
    assert many <= few + 2 and many < 25
    shallow, deep = (jobs_of(spark, lambda d=d: trees.forest(waves, COLS, "y", "value", 4, d))[1] for d in (2, 9))
    assert deep <= shallow + 2 and deep < 25


@pytest.mark.parametrize("fit", [
    lambda d: trees.boosted(d, COLS, "y", "value", 3, 4, 0.2), lambda d: trees.boosted(d, COLS, "k", "logistic", 12, 2, 0.3),
    lambda d: trees.forest(d, COLS, "k", "share", 7, 4, 2), lambda d: trees.forest(d, COLS, "y", "value", 4, 5, key=["id"])])
def test_rows_in_tasks_or_in_files_or_a_job_a_level(waves, monkeypatch, fit):
    models = [fit(waves)]
    monkeypatch.setattr(trees, "TASK_ROWS", 500)
    monkeypatch.setattr(trees, "BLOCK", 64)
    for settings in ({"CHUNK": 100, "FLUSH": 300, "BASE_BYTES": 2000, "HELD_BYTES": 6000}, {"TASKS": 0}):
        for name, value in settings.items():
            monkeypatch.setattr(held, name, value)
        models.append(fit(waves))
    for model in models[1:]:
        for name in ("feature", "cut", "missing_left", "value", "gain"):
            assert (getattr(models[0], name) == getattr(model, name)).all()


def scored_by_hand(model, row):
    total = 0.0
    for t in range(model.trees):
        node = 0
        while model.feature[t, node] >= 0:
            v = row[model.feature[t, node]]
            left = model.missing_left[t, node] if v is None or np.isnan(v) else v <= model.cut[t, node]
            node = 2 * node + 1 + (not left)
        total += model.value[t, node]
    total = model.base + (total / model.trees if model.mean else total)
    return 1 / (1 + np.exp(-total)) if model.link == "logistic" else total


def test_scores_equal_plain_paths(spark, waves):
    odd = [(None, 0.0, 1.0), (float("nan"), float("inf"), float("-inf")), (0.3, None, None), (-0.0, 0.0, -0.0)]
    plain = [tuple(r) for r in waves.limit(40).select(*COLS).collect()] * 3 + odd
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(plain)], "id int, a double, b double, c double").coalesce(1)
    for model in (trees.boosted(waves, COLS, "k", "logistic", 5, 3, 0.3), trees.forest(waves, COLS, "y", "value", 4, 6)):
        # cuts that are values of rows
        model.cut[model.feature == 0] = np.round(model.cut[model.feature == 0], 2)
        got = [r["s"] for r in model.score(df, "s").orderBy("id").collect()]
        assert got == pytest.approx([scored_by_hand(model, r) for r in plain], abs=1e-12)


def test_a_sample_is_ordered_by_a_column(spark):
    drawn = rows.sample_rows(spark.range(5000), 100, ["id"], draw=rows.row_hash(["id"], 42))
    assert "md5" not in re.search(r"Sort \[(.*?) ASC", drawn._jdf.queryExecution().optimizedPlan().toString())[1]
    hashes = sorted((r["h"], r["id"]) for r in spark.range(5000).withColumn("h", rows.row_hash(["id"], 42)).collect())
    assert {r["id"] for r in drawn.collect()} == {i for _, i in hashes[:100]}
