"""Registry and the telemetry views the queries share.

Every view reads a whole table.  ``events`` plays the part of a sensor log: vehicle
``user_id``, time ``ts``, tie-break ``event_id``, one signal in ``value`` and one in the
JSON text ``props``.  ``lineitem`` plays the fleet set.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.session import prepare

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6, *cols: str) -> DataFrame:
    """Round double columns (all of them unless named) for comparison with the SQL twin."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, places) for c in names})


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with signal ``k``, planted gaps ``x``, planted sentinel codes ``s`` and a label with gaps."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id") % 11
    return e.withColumns({
        "k": F.get_json_object("props", "$.k").cast("double"),
        "x": F.when(F.col("event_id") % 7 != 0, F.col("value")),
        "s": F.when(n == 0, F.lit(-22.0)).when(n == 1, F.lit(-40.0)).when(n == 2, F.lit(255.0)).otherwise(F.col("value")),
        "label": F.when(F.col("event_id") % 13 != 0, F.col("event_type")),
    }).drop("props")


EVENTS = """ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k,
         CASE WHEN event_id % 7 <> 0 THEN value END AS x,
         CASE event_id % 11 WHEN 0 THEN CAST(-22 AS DOUBLE) WHEN 1 THEN CAST(-40 AS DOUBLE)
              WHEN 2 THEN CAST(255 AS DOUBLE) ELSE value END AS s,
         CASE WHEN event_id % 13 <> 0 THEN event_type END AS label
  FROM events)"""

# one vehicle's rows in time order
SERIES = "PARTITION BY user_id ORDER BY ts, event_id"


def drive_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a driving log with SPEED, RPM and THROTTLE_POS."""
    return events(spark, sf_dir).select(
        "event_id", "user_id", "ts", F.col("value").alias("SPEED"), (F.lit(40.0) * F.col("k")).alias("RPM"),
        F.least(2 * F.col("value"), F.lit(100.0)).alias("THROTTLE_POS"),
    )


DRIVE_LOG = """log AS (
  SELECT event_id, user_id, ts, value AS SPEED, CAST(40 AS DOUBLE) * k AS RPM,
         least(2 * value, CAST(100 AS DOUBLE)) AS THROTTLE_POS
  FROM ev)"""

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the fleet set: sensors on about [0, 1]."""
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        (c("l_quantity") / 50.0).alias("ENGINE_LOAD"),
        (c("l_extendedprice") / 100000.0).alias("COOLANT_TEMP"),
        (c("l_extendedprice") / (c("l_quantity") + 1.0) / 1000.0).alias("AIRFLOW_PER_RPM"),
        (c("l_discount") * 9.0 + 0.05).alias("SHORT_FUEL_TRIM_1"),
        (c("l_tax") * 11.0 + 0.05).alias("TIMING_ADVANCE"),
        ((c("l_suppkey") % 97) / 100.0).alias("O2_B1S2"),
        ((c("l_partkey") % 89) / 100.0).alias("O2_B2S2"),
        (c("l_linenumber") / 7.0).alias("MAF"),
    )


FLEET = """fleet AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
         l_quantity / 50.0::DOUBLE AS ENGINE_LOAD,
         l_extendedprice / 100000.0::DOUBLE AS COOLANT_TEMP,
         l_extendedprice / (l_quantity + 1.0::DOUBLE) / 1000.0::DOUBLE AS AIRFLOW_PER_RPM,
         l_discount * 9.0::DOUBLE + 0.05::DOUBLE AS SHORT_FUEL_TRIM_1,
         l_tax * 11.0::DOUBLE + 0.05::DOUBLE AS TIMING_ADVANCE,
         (l_suppkey % 97) / 100.0::DOUBLE AS O2_B1S2,
         (l_partkey % 89) / 100.0::DOUBLE AS O2_B2S2,
         l_linenumber / 7.0::DOUBLE AS MAF
  FROM lineitem)"""


def union_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
