from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

from torqueline import session
from torqueline.plans import cleaning, labelling
from torqueline.sources import csv_logs, messages, sinks


@pytest.fixture
def logs(tmp_path):
    """Two files of one header, one of another with the columns in another order, and an output to leave out."""
    folder = tmp_path / "logs"
    folder.mkdir()
    a = "timestamp,RPM,ABSOLUTE_LOAD,O2_SENSORS,SPEED\n"
    (folder / "drive_1.csv").write_text(a + '2031-02-03T04:05:06.123456,700.5,40.25,"((), (False, True))",0.0\n'
                                            "2031-02-03T04:05:09.000001,,41.5,,\n")
    (folder / "drive_2.csv").write_text(a + "2031-02-04T10:00:00.250000,1200.5,39,,8\n")
    (folder / "idle_1.csv").write_text("timestamp,SPEED,RPM,MAF\n2031-02-05T11:30:00.750000,1.0,650,2.75\nbad,2.0,x,NaN\n")
    (folder / "merged.csv").write_text("timestamp,RPM\n2031-02-05T11:30:00,1\n")
    return str(folder)


def test_header_groups(spark, logs):
    groups = csv_logs.header_groups(spark, logs, exclude=["merged*"])
    assert sorted((len(g.columns), len(g.paths)) for g in groups) == [(4, 1), (5, 2)]


def test_headers_from_both_readers(spark, logs, tmp_path):
    def lines(df):
        return {r["path"].rsplit("/", 1)[-1]: r["header"] for r in df.collect()}

    assert lines(csv_logs.header_signature(spark, logs)) == lines(csv_logs.header_scan(spark, logs))
    wide = "timestamp," + ",".join(f"SENSOR_{i}" for i in range(3000))
    (tmp_path / "wide.csv").write_bytes(wide.encode() + b"\r\n1,2\r\n")
    assert lines(csv_logs.header_signature(spark, str(tmp_path))) == {"wide.csv": wide}


def test_columns_line_up_by_name(spark, logs):
    df = csv_logs.read_logs(spark, logs, exclude=["merged*"])
    assert dict(df.dtypes)["RPM"] == "double" and dict(df.dtypes)["O2_SENSORS"] == "string"
    got = {(r["source_file"], r["RPM"], r["SPEED"], r["MAF"]) for r in df.collect()}
    assert got == {("drive_1.csv", 700.5, 0.0, None), ("drive_1.csv", None, None, None), ("drive_2.csv", 1200.5, 8.0, None),
                   ("idle_1.csv", 650.0, 1.0, 2.75), ("idle_1.csv", None, 2.0, None)}
    assert df.filter("timestamp IS NULL").count() == 1
    assert df.filter("source_file = 'drive_1.csv' AND RPM IS NOT NULL").first()["timestamp"].microsecond == 123456


def test_common_columns(spark, logs):
    df = csv_logs.read_logs(spark, logs, exclude=["merged*"], how="common", provenance=False)
    assert df.columns == ["timestamp", "RPM", "SPEED"] and df.count() == 5


def test_groups_by_schema_and_prefix(spark, logs):
    groups = csv_logs.union_by_schema_group(spark, logs, exclude=["merged*"])
    assert [df.count() for df in groups.values()] == [3]
    typed = csv_logs.union_by_prefix_group(spark, logs, exclude=["merged*"])
    assert {r["source_type"]: r["count"] for r in typed.groupBy("source_type").count().collect()} == {"drive": 3, "idle": 2}


def test_inventory(spark, logs):
    out = {r["file"]: r["present"] for r in csv_logs.file_inventory(spark, logs, ["drive_1.csv", "none.csv"]).collect()}
    assert out == {"drive_1.csv": True, "none.csv": False}


def test_no_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(FileNotFoundError):
        csv_logs.read_logs(spark, str(tmp_path))


def test_message_file(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"timestamp": "2025-05-15T10:00:00", "driving_style": "aggressive", "data": {"RPM": 3200, "MAF": 12.5}}\n'
        '{"timestamp": "2025-05-15T10:00:00", "driving_style": "none", "data": {}, "status": "end"}\n')
    rows = messages.read_messages(spark, str(tmp_path)).collect()
    assert rows[0]["data"] == {"RPM": "3200", "MAF": "12.5"} and rows[0]["status"] is None and rows[1]["status"] == "end"


def test_csv_keeps_microseconds(spark, logs, tmp_path):
    df = csv_logs.read_logs(spark, logs, "idle*", provenance=False).dropna(subset=["timestamp"])
    sinks.write_csv(df, str(tmp_path / "out"))
    assert csv_logs.read_logs(spark, str(tmp_path / "out"), "part-*", provenance=False).collect() == df.collect()


def test_session_cleaning(spark, tmp_path):
    lines = ["timestamp,RPM,ENGINE_LOAD,ABSOLUTE_LOAD,OIL_TEMP,SPEED,driving_style"]
    lines += [f"2025-05-07T17:13:{i:02d}.000000,{50 if i == 3 else 700 + i},{i},{100 - i},-22,{'' if i == 5 else i * 2}," for i in range(20)]
    lines += [lines[-1], "2025-05-07T17:14:00.000000,,,,,,"]  # a duplicate row and an empty one
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    out = cleaning.clean_session(csv_logs.read_logs(spark, str(tmp_path), provenance=False)).orderBy("timestamp")
    assert out.columns == ["timestamp", "RPM", "ENGINE_LOAD", "ABSOLUTE_LOAD", "SPEED", "AVG_ENGINE_LOAD"]
    rows = out.collect()
    assert len(rows) == 20 and rows[0]["RPM"] == 0.0 and rows[19]["RPM"] == 1.0
    assert rows[3]["RPM"] == pytest.approx((710 - 700) / 19)  # the median of the plausible values
    assert rows[5]["SPEED"] == pytest.approx(20 / 38) and rows[4]["AVG_ENGINE_LOAD"] == pytest.approx(0.5)


def test_label_sessions_with_labels_of_their_own(spark, logs):
    df = csv_logs.read_logs(spark, logs, exclude=["merged*"])
    labels = df.selectExpr("timestamp", "CASE WHEN RPM > 770 THEN 'mild' ELSE 'UNKNOWN_STYLE' END AS driving_style", "source_file")
    out = labelling.label_sessions(df, tie=csv_logs.PROVENANCE, labels=labels).orderBy("timestamp").collect()
    assert [(r["new_session"], r["driving_style"]) for r in out] == [(0, None), (1, "Moderate"), (2, None)]


def test_dialect(spark, tmp_path):
    """Doubled quotes, line ends inside quotes, missing-value spellings; only files that need it are read whole."""
    (tmp_path / "a.csv").write_text('session,RPM,note\nx,1,"said ""hi"", ok"\ny,NA,"two\nlines"\nz,3,None\n')
    (tmp_path / "b.csv").write_bytes('\ufeff"session","RPM",note\nw,4,"a, b"\n'.encode())
    assert len(csv_logs.header_groups(spark, str(tmp_path))) == 1
    df = csv_logs.read_logs(spark, str(tmp_path), ts=None, text={"session", "note"}, provenance=False)
    assert {tuple(r) for r in df.collect()} == {
        ("x", 1.0, 'said "hi", ok'), ("y", None, "two\nlines"), ("z", 3.0, None), ("w", 4.0, "a, b")}


@pytest.mark.parametrize("header, names", [
    ("a,a.b,a", ("a", "a.b", "a.1")), ("a,a,a", ("a", "a.1", "a.2")), ("a,a.1,a", ("a", "a.1", "a.2")), ('"x,y",z', ("x,y", "z")), ("\ufeffa,b", ("a", "b"))])
def test_header_names(header, names):
    assert csv_logs._split_header(header) == names


def test_written_text_is_read_back(spark, tmp_path):
    rows = [(1, 'He said "no", twice'), (2, "a\nb"), (3, "  blanks  "), (4, None), (5, "back\\slash"), (6, 'end "')]
    sinks.write_csv(spark.createDataFrame(rows, "RPM int, note string"), str(tmp_path / "out"))
    df = csv_logs.read_logs(spark, str(tmp_path / "out"), ts=None, text={"note"}, provenance=False)
    assert sorted(map(tuple, df.collect())) == [(float(k), v) for k, v in rows]


def test_workers_without_the_package(tmp_path):
    """The package on the driver's path alone is enough."""
    (tmp_path / "a.csv").write_text("timestamp,RPM\n2031-02-03T04:05:06,1\n")
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from torqueline import build_session
from torqueline.sources.csv_logs import read_logs
from torqueline.operators.iforest import IsolationForest
spark = build_session("alone", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
assert read_logs(spark, {str(tmp_path)!r}).count() == 1
df = spark.range(500).selectExpr("id", "double(id % 7) as x", "double(id % 11) as y")
assert IsolationForest(["x", "y"], ["id"], trees=3, sample=32).fit(df).score(df).count() == 500
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scratch_tables_go_with_their_block(spark):
    with session.scratch(spark):
        df = session.settle(spark.range(5), "gone")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    assert os.path.exists(session.settle(spark.range(5), "stays").inputFiles()[0].removeprefix("file://"))
