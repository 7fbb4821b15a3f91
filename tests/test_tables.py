"""Column pruning, row filters, encodings, joins, profiles."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import at, plan_of
from torqueline.operators import columns, encode, joins, profile, quantiles, rows


@pytest.fixture(scope="module")
def planted(spark):
    data = [
        (at(i), None, 5.0, None, float(i), float(i), None if i % 5 else 1.0 * i, None if i % 100 > 18 else 2.0 * i,
         None if i % 2 else float(i), None if i % 2 else float(i))
        for i in range(100)
    ]
    return spark.createDataFrame(
        data, "timestamp timestamp, driving_style string, fixed double, empty double, a double, a2 double, "
        "gaps80 double, gaps81 double, h double, h2 double").persist()


def test_prune(planted):
    left = columns.drop_constant_columns(planted, ["timestamp", "driving_style"]).columns
    assert "fixed" not in left and "empty" not in left and "driving_style" in left
    assert columns.identical_columns(planted) == ["a2", "h2"]
    assert set(columns.drop_sparse_columns(planted, 0.8).columns) == set(planted.columns) - {"driving_style", "empty", "gaps81"}
    assert "driving_style" in columns.drop_sparse_columns(planted, 0.8, ["driving_style"]).columns
    both = columns.drop_constant_and_identical(planted, ["timestamp", "driving_style"])
    one_by_one = columns.drop_identical_columns(columns.drop_constant_columns(planted, ["timestamp", "driving_style"]))
    assert both.columns == one_by_one.columns
    assert columns.drop_columns_null_count(planted, 79).columns == [c for c in planted.columns if c not in (
        "driving_style", "empty", "gaps80", "gaps81")]


def test_near_equal_columns_stay(spark):
    df = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")  # same values, other rows
    assert columns.identical_columns(df) == []


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["Coolant [°C] ", " RPM [RPM]"])
    assert columns.normalise_column_names(df).columns == ["Coolant °C", "RPM RPM"]
    with pytest.raises(ValueError):
        columns.normalise_column_names(spark.createDataFrame([(1, 2)], ["a[", "a]"]))


def test_row_filters(spark):
    df = spark.createDataFrame([(at(0), 1.0, None, None), (at(1), None, None, None), (at(2), 1.0, 2.0, None)],
                               "timestamp timestamp, a double, b double, c double")
    assert rows.drop_rows_missing_over_ratio(df).count() == 2
    assert rows.require_n_present(df).count() == 1
    assert rows.require_any_present(df, ["a", "b", "nothing"]).count() == 2
    assert rows.drop_rows_missing_over_n(df, 2).count() == 2
    assert rows.range_filter(df, {"a": (0, 1), "b": (0, 2)}).count() == 1


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    first = {r[0] for r in rows.sample_rows(df, 100, ["id"]).collect()}
    assert len(first) == 100 and first == {r[0] for r in rows.sample_rows(df.repartition(7), 100, ["id"]).collect()}
    everything = [(r[0]) for r in df.orderBy(F.xxhash64(F.lit(42), "id")).limit(100).collect()]
    assert first == set(everything)
    assert rows.sample_rows(df, 9999, ["id"]).count() == 5000


def test_sample_by_a_given_hash(spark):
    df = spark.range(5000)
    draw = rows.row_hash(["id"], 42)
    expected = [r[0] for r in df.orderBy(draw, "id").limit(100).collect()]
    assert [r[0] for r in rows.sample_rows(df, 100, ["id"], draw=draw).collect()] == expected
    assert {r[0] for r in rows.sample_rows(df, 100, ["id"]).collect()} != set(expected)


def test_dedup_prunes_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = rows.dedup_by_key_first(df, ["k"], ["id"])
    assert plan_of(out).count("WindowGroupLimit") == 2
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (1, 1), (2, 2)]


def test_encoding(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("c",)], "s string")
    assert [r[0] for r in encode.label_encode(df, ["s"]).collect()] == [1, -1, 0, 2]
    assert sorted(r[0] for r in encode.label_encode(df, ["s"]).collect()) == [-1, 0, 1, 2]
    hot = encode.one_hot_drop_first(df, ["s"])
    assert hot.columns == ["s_b", "s_c"] and [tuple(r) for r in hot.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    wide = encode.map_to_columns(spark.createDataFrame([({"RPM": "1", "X": "bad"},), ({"MAF": "2.5"},)], "data map<string,string>"))
    assert wide.columns == ["MAF", "RPM", "X"] and [tuple(r) for r in wide.collect()] == [(None, 1.0, None), (2.5, None, None)]


def test_join_suffixes(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "id int, v int")
    b = spark.createDataFrame([(1, 9)], "id int, v int")
    assert joins.inner_equi_join(a, b, "id").columns == ["id", "v_x", "v_y"]
    assert joins.semi_join_flag(a, b, ["id"]).filter("chosen").count() == 2


@pytest.mark.parametrize("shape", ["normal", "few values", "heavy tail", "one value", "tiny"])
def test_selected_quantiles_are_exact(spark, shape):
    rng = np.random.default_rng(5)
    x = {
        "normal": rng.normal(size=4001), "few values": rng.integers(0, 4, 4000).astype(float),
        "heavy tail": np.exp(rng.normal(scale=8, size=4000)) * rng.choice([-1, 1], 4000),
        "one value": np.full(500, 3.25), "tiny": np.array([2.0, 1.0]),
    }[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"x": qs}, listed_rows=20, accuracy=50)
    for q in qs:
        assert got["x", q] == pytest.approx(np.quantile(x, q), rel=1e-12)
    assert quantiles.exact_quantiles(df.filter("x is null"), {"x": [0.5]}) == {("x", 0.5): None}


@pytest.mark.parametrize("listed_rows", [20, 20_000])
def test_quantiles_with_infinities_and_nan(spark, listed_rows):
    inf, nan = float("inf"), float("nan")
    x = [-inf] * 100 + [float(i % 37) for i in range(600)] + [inf] * 300
    df = spark.createDataFrame([(v,) for v in x] + [(nan,)] * 500 + [(None,)], "x double")
    qs = [0.0, 0.05, 0.5, 0.7002, 0.9, 1.0]
    got = quantiles.exact_quantiles(df, {"x": qs}, listed_rows=listed_rows, accuracy=50)
    assert [got["x", q] for q in qs] == [-inf, -inf, float(np.quantile(x[100:700], 399.5 / 599)), inf, inf, inf]
    assert math.isnan(quantiles.exact_quantiles(spark.createDataFrame([(inf,), (-inf,)], "x double"), {"x": [0.5]})["x", 0.5])
    assert quantiles.exact_quantiles(df.filter("isnan(x)"), {"x": [0.5]}, listed_rows=listed_rows) == {("x", 0.5): None}


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0)], "a double, b double, k double")
    r = {(x["x"], x["y"]): x["r"] for x in profile.correlation(df).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "k"] is None and r["k", "k"] is None and len(r) == 9


def test_resample_keeps_empty_hours(spark):
    df = spark.createDataFrame([(at(0), 1.0), (at(60), 3.0), (at(7300), 5.0)], "ts timestamp, x double")
    assert [r["x"] for r in profile.resample_mean(df, "ts", ["x"]).orderBy("ts").collect()] == [2.0, None, 5.0]


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(float(i),) for i in [*range(11), 100]], "x double")
    assert [r["n"] for r in profile.histogram(df, "x", 4).orderBy("bin").collect()] == [11, 0, 0, 1]
    box = profile.box_stats(df, ["x"]).first()
    assert (box["whisker_lo"], box["whisker_hi"], box["outliers"]) == (0.0, 10.0, 1)
    constant = profile.histogram(df.select(F.lit(2.0).alias("x")), "x", 2).orderBy("bin").collect()
    assert [r["n"] for r in constant] == [0, 12]


def test_density_integrates_to_about_one(spark):
    df = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=500)], "x double")
    curve = profile.kde_curve(df, "x").orderBy("x").toPandas()
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1.0, abs=0.05)
