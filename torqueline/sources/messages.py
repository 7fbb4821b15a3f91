"""Ingest messages, S9: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from torqueline.functions.text import normalize_timestamp_key
from torqueline.schema import MESSAGE


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MESSAGE).json(path)


def stream_messages(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Arriving message files, each row with the file it came from."""
    reader = spark.readStream.schema(MESSAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select(
        *MESSAGE.names,
        F.struct(
            F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        ).alias("origin"),
    )


def with_arrival(messages: DataFrame) -> DataFrame:
    """Session key and arrival position: file time, file, block, line."""
    return messages.select(
        *MESSAGE.names,
        normalize_timestamp_key("timestamp").alias("session"),
        F.struct("origin.at", "origin.file", "origin.block", F.monotonically_increasing_id().alias("line")).alias("seq"),
    )
