from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import at
from torqueline.operators.sequence import Thresholds
from torqueline.plans.driving import analyse_driving
from torqueline.streaming import driving, ingest, sessions


def message(second, style="normal", status=None, **data):
    out = {"timestamp": f"2025-05-15 10:00:{second:02d}", "driving_style": style, "data": data}
    return json.dumps(out | ({"status": status} if status else {}))


def test_ingest_tracks_and_cleans_sessions(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    first = [message(1, "none", "start"), message(1, RPM=800, SPEED=10), message(1, RPM=900, SPEED=20, MAF=3.5), message(2, "none", "start")]
    (box / "a.json").write_text("\n".join(first) + "\n")
    folders = [str(tmp_path / n) for n in ("raw", "status", "checkpoint", "cleaned")]

    def run():
        ingest.start_ingest(spark, str(box), folders[0], folders[1], folders[2], folders[3], available_now=True,
                            process=lambda df: df).awaitTermination()
        return {r["session"]: r["status"] for r in ingest.pipeline_status(ingest.read_status(spark, folders[1])).collect()}

    one, two = "2025-05-15T10-00-01", "2025-05-15T10-00-02"
    assert run() == {one: "started", two: "started"}
    (box / "b.json").write_text(message(1, RPM=1000, OIL=5) + "\n" + message(1, "none", "end") + "\n")
    assert run() == {one: "done", two: "started"}
    raw = spark.read.parquet(folders[0])
    assert raw.count() == 3 and raw.filter("driving_style = 'none'").count() == 0
    cleaned = spark.read.option("header", True).csv(f"{folders[3]}/cleaned_{one}")
    assert cleaned.count() == 3 and set(cleaned.columns) == {"timestamp", "driving_style", "RPM", "SPEED", "MAF", "OIL"}
    changes = ingest.read_status(spark, folders[1])
    gone = spark.createDataFrame([(two,)], "session string")
    assert [r["session"] for r in ingest.pipeline_status(changes, gone).collect()] == [one]
    feed = [r["status"] for r in ingest.status_feed(changes).filter(F.col("session") == one).orderBy("batch", "seq", "step").collect()]
    assert feed == ["started", "processed", "done"]


def test_each_csv_is_its_own_event(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.csv").write_text("timestamp,RPM\n2025-05-07T17:13:45.868476,756.5\n")
    (box / "b.csv").write_text("timestamp,MAF,RPM\n2025-05-07T17:13:45.868476,3.5,700\n")
    ingest.start_csv_drop(spark, str(box), str(tmp_path / "out"), str(tmp_path / "status"), str(tmp_path / "cp"),
                          available_now=True, process=lambda df: df).awaitTermination()
    status = ingest.pipeline_status(ingest.read_status(spark, str(tmp_path / "status")))
    assert {r["session"]: r["status"] for r in status.collect()} == {"a.csv": "done", "b.csv": "done"}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "cleaned_b")).columns == ["timestamp", "MAF", "RPM"]


@pytest.fixture(scope="module")
def drives(spark):
    rng = random.Random(11)
    rows = [(rng.choice([1, 1, 2, 3]), at(i * 0.5), i, rng.choice([None, 0.0, rng.uniform(0, 120)]), rng.uniform(700, 3500),
             rng.choice([None, rng.uniform(5, 90)])) for i in range(600)]
    return spark.createDataFrame(rows, "vehicle int, timestamp timestamp, n int, SPEED double, RPM double, THROTTLE_POS double").persist()


def test_stream_equals_batch(spark, drives, tmp_path):
    path = str(tmp_path / "in")
    for lo in range(0, 600, 150):
        drives.filter(F.col("n").between(lo, lo + 149)).coalesce(1).write.mode("append").parquet(path)
    rows = spark.readStream.schema(drives.schema).option("maxFilesPerTrigger", 1).parquet(path)
    driving.start_driving_stream(
        rows, *[str(tmp_path / n) for n in ("out", "late", "state", "cp")], ["vehicle"], tie=["n"], available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = analyse_driving(drives, "timestamp", ["vehicle"], ["n"]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(str(tmp_path / "late")).count() == 0


@pytest.mark.parametrize("size", [2_000_000, 40])
def test_one_batch_after_another(spark, drives, size):
    head, tail = drives.filter("n < 300"), drives.filter("n >= 300")
    limits = Thresholds()
    done, late = driving.analyse_batch(head, None, "timestamp", ["vehicle"], ["n"], limits, size)
    state = driving.last_rows(done, "timestamp", ["vehicle"], ["n"])
    assert late.count() == 0 and state.count() == 3
    # the last rows of the head arrive again: they are late
    more, late = driving.analyse_batch(tail.unionByName(head.filter("n >= 290")), state, "timestamp", ["vehicle"], ["n"], limits, size)
    assert late.count() == 10
    want = analyse_driving(drives, "timestamp", ["vehicle"], ["n"])
    cols = ["n", "delta_time_s", "SPEED", "acceleration_g", "RPM_roc", "driving_style_analyzed"]
    got = done.select(cols).unionByName(more.select(cols))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_session_window_boundary(spark):
    df = spark.createDataFrame([(1, at(0)), (1, at(3600)), (1, at(7201))], "v int, ts timestamp")
    out = sessions.session_window_stream(df, "ts", ["v"], 3600).orderBy("start").collect()
    assert [r["rows"] for r in out] == [2, 1]  # a gap of exactly an hour stays in the session


def test_session_log_keeps_open_sessions_and_late_bridges(spark, tmp_path):
    gap = 600
    files = [[(1, 0), (1, 300), (2, 0), (1, 5000)], [(1, 2000), (2, 900)], [(1, 900), (1, 1500), (3, 0)], [(2, 1500), (2, 2700)]]
    rows = [(v, at(s)) for part in files for v, s in part]
    source = str(tmp_path / "in")
    for part in files:
        spark.createDataFrame([(v, at(s)) for v, s in part], "v int, ts timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("v int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    log, kinds = str(tmp_path / "log"), T.StructType([T.StructField("v", T.IntegerType())])
    sessions.start_session_log(stream, log, str(tmp_path / "checkpoint"), "ts", ["v"], gap, available_now=True).awaitTermination()
    whole = sessions.session_window_stream(spark.createDataFrame(rows, "v int, ts timestamp"), "ts", ["v"], gap)
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, sessions.read_sessions(spark, log, kinds, ["v"], gap).collect())) == want
    # vehicle 1: the late rows join the first two stretches; the last session of each vehicle is open
    assert [(r[0], r[3]) for r in want] == [(1, 5), (1, 1), (2, 1), (2, 2), (2, 1), (3, 1)]
    sessions.compact_sessions(spark, log, str(tmp_path / "short"), kinds, ["v"], gap)
    assert sorted(map(tuple, sessions.read_sessions(spark, str(tmp_path / "short"), kinds, ["v"], gap).collect())) == want
