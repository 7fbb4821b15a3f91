"""Sinks: S11-S13."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Columns of an empty raw store.
RAW_STORE = T.StructType([
    T.StructField("session", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("driving_style", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), only_parts: bool = False) -> None:
    """Header, no index, quotes doubled, blanks kept.  Text form of a timestamp keeps its microseconds.

    With ``only_parts`` the partitions that ``df`` has rows for are replaced and others stay.
    """
    writer = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option(
        "timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic" if only_parts else "static")
    writer.csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append without rewriting what is stored; a map column takes new sensors as they come."""
    df.write.mode("append").parquet(path)


def store_exists(spark: SparkSession, path: str) -> bool:
    try:
        # a given schema keeps Spark from reading a footer
        spark.read.schema(RAW_STORE).parquet(path)
    except AnalysisException:
        return False
    return True


def init_store(spark: SparkSession, path: str, schema: T.StructType = RAW_STORE) -> bool:
    """Create an empty store unless one is there; True if it was created."""
    if store_exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return True


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    """A small value, such as a fitted model, as one JSON line."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path).first()[0])
