from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from torqueline import functions as fn
from torqueline.operators import scaling


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items()) or "z int"
    return spark.createDataFrame([tuple(values.values()) or (0,)], schema).select(column).first()[0]


@pytest.mark.parametrize("text, number", [
    ("1.5", 1.5), (" 2 ", 2.0), ("1.5d", None), ("NaN", None), ("abc", None), ("", None), ("1e3", 1000.0)])
def test_to_number(spark, text, number):
    assert one(spark, fn.to_number("t"), t=text) == number


def test_sentinels_and_range(spark):
    assert one(spark, fn.sentinel_to_null("x"), x=-40.0) is None
    assert one(spark, fn.sentinel_to_null("x"), x=-41.0) == -41.0
    assert one(spark, fn.outside_to_null("x", 100, 6000), x=100.0) == 100.0
    assert one(spark, fn.outside_to_null("x", 100, 6000), x=99.9) is None


def test_means_and_ratios(spark):
    df = spark.createDataFrame([(1.0, None, 0.0)], "a double, b double, z double")
    row = df.select(
        fn.row_mean("a", "b").alias("m"), fn.pair_mean("a", "b").alias("p"), fn.safe_ratio("a", "z").alias("r"),
        fn.eps_ratio("a", "z").alias("e"), fn.row_mean("b").alias("n")).first()
    assert (row["m"], row["p"], row["r"], row["n"]) == (1.0, None, None, None)
    assert row["e"] == pytest.approx(1000.0)


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (0.5,)], "x double")
    assert [r[0] for r in df.select(fn.clip("x", 0, 1)).collect()] == [None, 0.0, 1.0, 0.5]


@pytest.mark.parametrize("x, want", [(0.4, 0.0), (0.6, 0.0), (0.8, 0.5), (1.3, 1.0), (None, 0.0)])
def test_stress_upper(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(fn.stress_upper("x", 0.6)).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("x, want", [(0.1, 0.5), (0.2, 0.0), (0.5, 0.0), (0.9, 0.5), (-1.0, 1.0), (None, 0.0)])
def test_stress_two_sided(spark, x, want):
    df = spark.createDataFrame([(x,)], "x double")
    assert df.select(fn.stress_two_sided("x", 0.2, 0.8)).first()[0] == pytest.approx(want)


def test_degenerate_thresholds(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(fn.stress_upper("x", 1.0)).collect()] == [0.0, 1.0, 0.0]
    assert [r[0] for r in df.select(fn.stress_two_sided("x", 0.0, 0.5)).collect()] == [1.0, 1.0, 1.0]


def test_index_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.00125,), (0.00375,), (2.0,), (None,)], "s double")
    out = scaling.add_weighted_index(df, {"s": 1.0}).collect()
    assert [r["MaintenanceNeed"] for r in out] == [0.12, 0.38, 100.0, 0.0]


def test_scalers_on_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "a double, k double")
    assert [tuple(r) for r in scaling.min_max(df, ["a", "k"]).collect()] == [(0.0, 0.0), (1.0, 0.0), (None, None)]
    assert [tuple(r) for r in scaling.standardise(df, ["a", "k"]).collect()] == [(-1.0, 0.0), (1.0, 0.0), (None, None)]


def test_fill_leaves_types_of_whole_columns(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "i long, x double")
    out = scaling.fill(df, ["i", "x"], "median")
    assert dict(out.dtypes)["i"] == "bigint" and [r["x"] for r in out.orderBy("i").collect()] == [1.0, 2.5, 4.0]


def test_median_fill_and_scale_equals_two_steps(spark):
    df = spark.createDataFrame([(float(i) if i % 3 else None, None, 7.0) for i in range(20)], "a double, b double, c double")
    want = scaling.min_max(scaling.fill(df, df.columns), df.columns).collect()
    assert scaling.median_fill_and_scale(df, df.columns).collect() == want


def test_timestamps(spark):
    assert one(spark, fn.normalize_timestamp_key("t"), t="2025/05/15 10:00:00.5") == "2025-05-15T10-00-00-5"
    assert one(spark, fn.parse_timestamp("t"), t="2025-05-15T10-00-00") == datetime(2025, 5, 15, 10)
    assert one(spark, fn.parse_timestamp("t"), t="nonsense") is None
    assert one(spark, fn.display_timestamp("t"), t="2025-05-15T01-05-00") == "23:05 15/05/2025"
    assert one(spark, fn.display_timestamp("t"), t="2025-05-15") == "2025-05-15"


def test_days_floor(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 10),)], "d timestamp")
    noon = datetime(2024, 1, 9, 12)
    assert df.select(fn.days_until("d", noon), fn.days_since("d", noon)).first() == (0, -1)


def test_labels(spark):
    df = spark.createDataFrame([("mild",), ("UNKNOWN_STYLE",), ("Sporty",), (None,)], "s string")
    assert [r[0] for r in df.select(fn.canonical_label("s")).collect()] == ["Moderate", None, "Sporty", None]
    assert [r[0] for r in df.select(fn.map_values("s", {"mild": 1})).collect()] == [1, None, None, None]
    assert one(spark, fn.rate(F.lit(5.0), F.lit(1.0), F.lit(0.0))) == 0.0
