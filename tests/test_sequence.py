from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import at
from torqueline.operators import sequence as seq
from torqueline.operators.timeline import timeline
from torqueline.plans.driving import analyse_driving, style_summary


def styles(df, **more):
    out = analyse_driving(df, "timestamp", ["vehicle"], ["n"], **more)
    return [r["driving_style_analyzed"] for r in out.orderBy("vehicle", "timestamp", "n").collect()]


def test_hold_keeps_aggressive_until_revs_fall(log):
    assert styles(log([(0, 50, 2800, 50), (1, 50, 2400, 20), (2, 50, 2200, 20)])) == ["Aggressive", "Aggressive", "Moderate"]


def test_hard_braking_and_standstill(log):
    assert styles(log([(0, 60, 1500, 10), (1, 40, 1500, 10), (2, 40, 1500, 10)])) == ["Passive", "Aggressive", "Passive"]
    assert styles(log([(0, 0, 3000, 60), (1, 2, 3000, 60)])) == ["Passive", "Passive"]


def test_equal_timestamps_give_rate_zero(log):
    out = analyse_driving(log([(0, 60, 1500, 10), (0, 10, 1500, 90)]), "timestamp", ["vehicle"], ["n"])
    assert [r["acceleration_g"] for r in out.collect()] == [0.0, 0.0]


def test_missing_column_counts_as_zero_and_gaps_are_filled(spark):
    df = spark.createDataFrame([(at(0), "x", 2600.0), (at(1), None, None)], "timestamp timestamp, SPEED string, RPM double")
    out = analyse_driving(df).orderBy("timestamp").collect()
    assert [(r["SPEED"], r["RPM"], r["THROTTLE_POS"]) for r in out] == [(0.0, 2600.0, 0.0), (0.0, 2600.0, 0.0)]


def test_unknown_style_without_required_columns(spark):
    df = spark.createDataFrame([(at(0), 1.0)], "timestamp timestamp, RPM double")
    assert seq.driving_style(timeline(df, "timestamp")).frame.first()["driving_style_analyzed"] == "UNKNOWN_STYLE"


def loop_styles(rows):
    """Row-by-row statement of the rule."""
    out, aggressive, before = [], False, None
    for second, speed, rpm, throttle in rows:
        gap = second - before[0] if before else 0
        g, rr, tr = [((v - w) / gap if before and gap else 0.0) for v, w in zip(
            (speed / 3.6, rpm, throttle), (before[1] / 3.6, before[2], before[3]) if before else (0, 0, 0))]
        g /= 9.80665
        moving = speed > 2
        event = moving and (g < -0.25 or (rpm > 2700 and throttle > 40) or (g > 0.1 and (rr > 500 or tr > 45)))
        aggressive = event or (aggressive and rpm > 2300 and moving)
        out.append("Aggressive" if aggressive else
                   "Moderate" if moving and (rpm > 2100 or throttle > 25) else "Passive")
        before = (second, speed, rpm, throttle)
    return out


@pytest.mark.parametrize("size", [2_000_000, 50])
def test_latch_equals_row_loop(log, size):
    rng = random.Random(3)
    rows, t = [], 0.0
    for _ in range(1500):
        t += rng.choice([0.5, 1.0, 2.0])
        rows.append((t, rng.choice([0.0, rng.uniform(0, 120)]), rng.uniform(700, 3500), rng.uniform(5, 90)))
    df = log([(*r, 1) for r in rows])
    assert styles(df, rows_per_slab=size) == loop_styles(rows)


def test_style_summary(log):
    out = style_summary(analyse_driving(log([(0, 50, 2800, 50), (1, 0, 800, 0), (2, 0, 800, 0)]), "timestamp", ["vehicle"], ["n"]))
    assert [tuple(r) for r in out.collect()] == [("Passive", 2, pytest.approx(66.6666667)), ("Aggressive", 1, pytest.approx(33.3333333))]


def test_sessions_need_more_than_the_gap(spark):
    df = spark.createDataFrame([(at(0),), (at(3600),), (at(7201),)], "ts timestamp")
    out = seq.sessionize(timeline(df, "ts")).frame.orderBy("ts").collect()
    assert [r["new_session"] for r in out] == [0, 0, 1]


@pytest.mark.parametrize("seconds, label", [(59, None), (60, "idle"), (61, "idle")])
def test_idle_needs_sixty_seconds(spark, seconds, label):
    df = spark.createDataFrame([(at(0), 0.0), (at(seconds), 0.0), (at(seconds + 1), 5.0)], "ts timestamp, SPEED double")
    out = seq.idle_runs(timeline(df, "ts")).frame.orderBy("ts").collect()
    assert [r["driving_style"] for r in out] == [label, label, None]


def test_missing_speed_splits_an_idle_run(spark):
    df = spark.createDataFrame([(at(0), 0.0), (at(40), None), (at(80), 0.0)], "ts timestamp, SPEED double")
    assert seq.idle_runs(timeline(df, "ts")).frame.filter("driving_style = 'idle'").count() == 0


def test_failed_read_clears_a_held_value(spark):
    polls = spark.createDataFrame(
        [(at(0), "RPM", 800.0), (at(0), "MAF", 3.0), (at(1), "RPM", 900.0), (at(2), "RPM", None), (at(2), "MAF", 4.0)],
        "ts timestamp, signal string, value double")
    rows = seq.polled_rows(polls, ["ts"], ["RPM", "MAF"])
    out = seq.hold_last_multirate(timeline(rows, "ts"), ["RPM", "MAF"]).frame.orderBy("ts").collect()
    assert [(r["RPM"], r["MAF"]) for r in out] == [(800.0, 3.0), (900.0, 3.0), (None, 4.0)]


def test_first_row_counts_as_a_status_change(spark):
    df = spark.createDataFrame([(at(0), None), (at(1), None), (at(2), "done"), (at(3), "done")], "ts timestamp, s string")
    out = seq.status_change(timeline(df, "ts"), "s").orderBy("ts").collect()
    assert [r["s"] for r in out] == [None, "done"]


def test_run_ids_start_after_false(spark):
    df = spark.createDataFrame([(at(i), f) for i, f in enumerate([False, True, True, None, True])], "ts timestamp, f boolean")
    out = seq.run_ids(timeline(df, "ts"), F.col("f")).frame.orderBy("ts").collect()
    assert [r["run_id"] for r in out] == [0, 1, 1, 2, 3]


def test_fused_scan_equals_single_operators(spark):
    rng = random.Random(9)
    rows = [(rng.choice([1, 2]), at(i // 2), i, *[rng.choice([None, rng.uniform(0, 100)]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "v int, ts timestamp, n int, SPEED double, RPM double, THROTTLE_POS double")
    signals = ["SPEED", "RPM", "THROTTLE_POS"]
    tl = seq.forward_fill(seq.time_gap(timeline(df, "ts", ["v"], ["n"]), "delta_time_s", first=0), signals)
    tl = tl.with_columns({c: F.coalesce(c, F.lit(0.0)) for c in signals})
    tl = tl.with_columns({"SPEED_mps": F.col("SPEED") * (1 / 3.6)})
    tl = seq.rates_of_change(
        tl, {"acceleration_mps2": "SPEED_mps", "RPM_roc": "RPM", "THROTTLE_roc": "THROTTLE_POS"}, "delta_time_s")
    want = tl.frame
    got = seq.fill_and_rate(timeline(df, "ts", ["v"], ["n"], 30)).frame.select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("size", [2_000_000, 20])
def test_fused_sessions_equal_single_operators(spark, size):
    rng = random.Random(13)
    t, rows = 0, []
    for i in range(300):
        t += rng.choice([5, 30, 30, 4000])
        rows.append((rng.choice([1, 2]), at(t), i, rng.choice([None, 0.0, 0.0, 0.0, 9.0]), rng.choice([None, "Passive"])))
    df = spark.createDataFrame(rows, "v int, ts timestamp, n int, SPEED double, driving_style string")
    tl = seq.sessionize(seq.time_gap(timeline(df, "ts", ["v"], ["n"])), 3600, gap="time_diff")
    want = seq.idle_runs(tl).frame
    got = seq.sessions_and_idle(timeline(df, "ts", ["v"], ["n"], size)).frame.select(want.columns)
    assert want.filter("driving_style = 'idle'").count() > 0
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
