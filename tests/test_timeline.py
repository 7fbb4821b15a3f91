"""Cut series must give what an uncut window gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import at
from torqueline.operators import sequence as seq
from torqueline.operators.timeline import SLAB, timeline


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        vehicle = 1 if rng.random() < 0.5 else rng.choice([None, 2, 3, 4, 5])
        second = rng.choice([0, 0, rng.randrange(20_000)])  # a third of the rows share one time
        data.append((vehicle, at(second), i, rng.choice([None, 0.0, rng.uniform(0, 50)])))
    return spark.createDataFrame(data, "vehicle int, ts timestamp, n int, x double").persist()


def chain(df, keys, rows_per_slab):
    tl = timeline(df, "ts", keys, ["n"], rows_per_slab)
    split = tl.split
    tl = tl.scan(
        previous={"prev": F.col("x")}, following={"next": F.col("x")}, latest={"last": F.col("x")},
        upcoming={"soon": F.col("x")}, running={"total": F.lit(1).cast("long")}, latest_before={"held": F.col("x")})
    tl = seq.rolling_std(tl, "x", "sd")
    tl = seq.run_spans(tl, F.col("x") == 0)
    return split, {r["n"]: r for r in tl.frame.collect()}


@pytest.mark.parametrize("keys", [["vehicle"], []])
def test_split_equals_whole(rows, keys):
    split, want = chain(rows, keys, 1_000_000)
    assert not split
    for size in (1, 40):
        split, got = chain(rows, keys, size)
        assert split
        assert got == want


def test_slabs_are_stable_under_repartition(rows):
    def places(df):
        tl = timeline(df, "ts", ["vehicle"], ["n"], 40)
        return {r["n"]: r[SLAB] for r in tl.df.select("n", SLAB).collect()}

    first = places(rows)
    assert places(rows.repartition(7)) == first
    assert max(first.values()) > 10  # the large series really is cut


def test_rows_sharing_a_timestamp_are_cut_too(spark):
    df = spark.range(4000).select(F.lit(1).alias("v"), F.lit(at(0)).alias("ts"), F.col("id").alias("n"))
    tl = timeline(df, "ts", ["v"], ["n"], 100)
    sizes = [r["count"] for r in tl.df.groupBy(SLAB).count().collect()]
    assert tl.split and len(sizes) > 10 and max(sizes) < 1500
    index = seq.row_index(tl).frame.filter(F.col("row_index") != F.col("n")).count()
    assert index == 0


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "v int, ts timestamp, n int, x double")
    assert seq.time_gap(timeline(empty, "ts", ["v"], ["n"])).frame.count() == 0
    one = spark.createDataFrame([(1, at(0), 0, 2.0)], empty.schema)
    row = seq.rolling_std(seq.time_gap(timeline(one, "ts", ["v"], ["n"])), "x", "sd").frame.first()
    assert row["time_diff"] is None and row["sd"] == 0.0
