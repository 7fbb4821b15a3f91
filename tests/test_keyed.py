"""Cleaning of many sessions at once, against cleaning them one by one."""

from __future__ import annotations

import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from torqueline.plans.cleaning import clean_session
from torqueline.plans.keyed import clean_sessions, medians_by_key
from torqueline.streaming import ingest

COLS = ["RPM", "SPEED", "MAF", "ENGINE_LOAD", "ABSOLUTE_LOAD", "INTAKE_TEMP", "OIL_TEMP", "COOLANT_TEMP", "TWIN", "FLAT", "THIN"]
SCHEMA = "session string, timestamp timestamp, driving_style string, " + ", ".join(f"{c} double" for c in COLS)


def sessions(seed=3, n=6):
    """Sessions that differ in which columns are constant, equal to another, sparse or missing."""
    rng = random.Random(seed)
    out = []
    for s in range(n):
        gone = set(rng.sample(COLS[2:], rng.randint(0, 3)))
        twin, flat = rng.choice(COLS[:4]), rng.choice([True, False])
        for k in range(rng.randint(12, 30)):
            v = {c: None if c in gone or rng.random() < 0.15 else rng.choice([-22.0, -40.0, 255.0]) if rng.random() < 0.05 else round(rng.uniform(1, 90), 1) for c in COLS}
            v["RPM"] = rng.choice([None, 50.0, 7000.0, 900.0 + k, 1500.0 + k])
            v["TWIN"] = v[twin] if s % 2 else v["TWIN"]
            v["FLAT"] = 7.0 if flat else v["FLAT"]
            v["THIN"] = v["THIN"] if k % 9 == 0 else None
            row = (f"s{s}", at(k), rng.choice(["calm", None]), *[v[c] for c in COLS])
            out += [row] * rng.choice([1, 1, 2])
            if k == 5:
                out.append((f"s{s}", at(100 + k), "calm", *[None] * len(COLS)))
    out.append(("lone", at(0), "calm", *[1.0] * len(COLS)))
    return out


@pytest.mark.parametrize("protect_all", [False, True])
def test_keyed_cleaning_equals_one_by_one(spark, protect_all):
    df = spark.createDataFrame(sessions(), SCHEMA).repartition(4)
    got = clean_sessions(df, "session", protect_all=protect_all)
    assert {"AVG_ENGINE_LOAD", "TEMP_MEAN", "AIRFLOW_PER_RPM"} <= set(got.columns)
    rows = [r.asDict() for r in got.collect()]
    for name in sorted({r[0] for r in sessions()}):
        want = clean_session(df.where(F.col("session") == name).drop("session"), protect_all=protect_all)
        expected = [r.asDict() for r in want.collect()]
        own = [r for r in rows if r["session"] == name]

        def shape(r):
            return tuple(None if r.get(c) is None else round(r[c], 9) if isinstance(r[c], float) else str(r[c]) for c in got.columns if c != "session")

        assert sorted(map(str, map(shape, own))) == sorted(map(str, map(shape, expected))), name


def test_medians_by_key(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 4.0, 2.0), ("a", 3.0, None), ("a", 3.0, 5.0), (None, 9.0, None)], "k string, x double, y double")
    assert {r["k"]: dict(r["__median"]) for r in medians_by_key(df, "k", ["x", "y"]).collect()} == {"a": {0: 3.0, 1: 3.5}, None: {0: 9.0}}


def test_empty_table(spark):
    df = spark.createDataFrame(sessions(), SCHEMA)
    assert clean_sessions(df.where("false"), "session").count() == 0


def test_files_of_a_batch_are_cleaned_together(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for f, shift in (("a", 0), ("b", 500)):
        lines = [f"2025-05-07T17:13:{k:02d}.000000,{700 + shift + k},{k * 2}" for k in range(20)]
        (box / f"{f}.csv").write_text("timestamp,RPM,SPEED\n" + "\n".join(lines) + "\n")
    (box / "c.csv").write_text("timestamp,MAF,RPM\n" + "\n".join(f"2025-05-07T17:14:{k:02d}.000000,{k / 2},{900 + k}" for k in range(10)) + "\n")
    out, status = str(tmp_path / "out"), str(tmp_path / "status")
    ingest.start_csv_drop(spark, str(box), out, status, str(tmp_path / "cp"), available_now=True, process_all=clean_sessions).awaitTermination()
    final = {r["session"]: r["status"] for r in ingest.pipeline_status(ingest.read_status(spark, status)).collect()}
    assert final == {"a.csv": "done", "b.csv": "done", "c.csv": "done"}
    cleaned = spark.read.option("header", True).option("inferSchema", True).csv(out)
    got = {r["source_file"]: tuple(r)[1:] for r in cleaned.groupBy("source_file").agg(F.count("*"), F.min("RPM"), F.max("RPM"), F.count("MAF"), F.count("SPEED")).collect()}
    assert got == {"a.csv": (20, 0.0, 1.0, 0, 20), "b.csv": (20, 0.0, 1.0, 0, 20), "c.csv": (10, 0.0, 1.0, 10, 0)}
