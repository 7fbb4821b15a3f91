from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from torqueline import build_session  # noqa: E402

START = datetime(2024, 1, 1, 8, 0, 0)


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def plan_of(df) -> str:
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split(
        "\n(1) ")[0]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log(spark):
    """Driving log frame from (seconds, SPEED, RPM, THROTTLE_POS[, vehicle]) tuples, numbered as a tie-break."""
    def build(rows):
        full = [(r[4] if len(r) > 4 else 1, at(r[0]), i, float(r[1]), float(r[2]), float(r[3])) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "vehicle int, timestamp timestamp, n int, SPEED double, RPM double, THROTTLE_POS double")
    return build
