"""Fixed names of the telemetry model."""

from __future__ import annotations

from pyspark.sql import types as T

# Signals polled by the logger, fast ones first.
FAST_SIGNALS = ["RPM", "THROTTLE_POS", "SPEED"]
SLOW_SIGNALS = [
    "FUEL_PRESSURE", "ENGINE_LOAD", "COOLANT_TEMP", "INTAKE_TEMP", "TIMING_ADVANCE", "MAF",
    "INTAKE_PRESSURE", "SHORT_FUEL_TRIM_1", "LONG_FUEL_TRIM_1", "SHORT_FUEL_TRIM_2",
    "LONG_FUEL_TRIM_2", "COMMANDED_EQUIV_RATIO", "O2_B1S2", "O2_B2S2", "O2_S1_WR_VOLTAGE",
    "COMMANDED_EGR",
]
SIGNALS = FAST_SIGNALS + SLOW_SIGNALS

# Sensors drawn in the trend table.
TREND_SIGNALS = [
    "RPM", "ENGINE_LOAD", "ABSOLUTE_LOAD", "COOLANT_TEMP", "INTAKE_TEMP", "OIL_TEMP",
    "INTAKE_PRESSURE", "BAROMETRIC_PRESSURE", "CONTROL_MODULE_VOLTAGE",
]

# Sensors imputed in the fleet set.
FLEET_SIGNALS = [
    "RPM", "THROTTLE_POS", "SPEED", "ENGINE_LOAD", "COOLANT_TEMP", "INTAKE_TEMP", "MAF",
    "AIRFLOW_PER_RPM", "TIMING_ADVANCE", "INTAKE_PRESSURE", "SHORT_FUEL_TRIM_1",
    "LONG_FUEL_TRIM_1", "SHORT_FUEL_TRIM_2", "LONG_FUEL_TRIM_2", "O2_B1S2", "O2_B2S2",
    "O2_S1_WR_VOLTAGE",
]

# Text columns of a log; every other column of a log is a number.
TEXT_COLUMNS = {
    "timestamp", "driving_style", "road_type", "traffic_condition", "driving_style_analyzed",
    "road_type_analyzed", "traffic_condition_analyzed", "O2_SENSORS", "source_file", "source_type",
}

# Name prefixes of the grouped external files, first match wins.
FILE_PREFIXES = ["drive", "idle", "live", "long", "ufpe"]

MESSAGE = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("driving_style", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
    T.StructField("status", T.StringType()),
])
