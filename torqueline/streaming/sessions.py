"""Gap sessions on a stream, T6.

A stream with a watermark reports a session once, when it is closed.  Where open sessions have to be seen as well, or
rows may come late without limit, every micro-batch writes the sessions of its own rows to a log; reading the log merges
those that overlap or touch, so a session is there from its first row and is replaced as it grows, or as a late
row joins two of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def session_window_stream(rows: DataFrame, ts: str, keys: Sequence[str], gap_s: int = 3600, late: str = "1 hour") -> DataFrame:
    """Start, end and row count per session of a series.

    As in the batch operator a session closes at a gap of more than ``gap_s`` seconds:
    windows that only touch are merged.  Partial sessions are merged before the shuffle.
    """
    rows = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(ts, late)
    return (
        rows.groupBy(*keys, F.session_window(ts, f"{gap_s} seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first_row"), F.max(ts).alias("last_row"))
        .select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "first_row", "last_row")
    )


def start_session_log(rows: DataFrame, log_dir: str, checkpoint: str, ts: str, keys: Sequence[str], gap_s: int = 3600,
                      available_now: bool = False) -> StreamingQuery:
    """Write the sessions of each micro-batch into a folder of its number, so a batch that runs again replaces itself."""
    def handle(batch: DataFrame, number: int) -> None:
        session_window_stream(batch, ts, keys, gap_s).write.mode("overwrite").parquet(f"{log_dir}/batch={number}")

    writer = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def merged_sessions(parts: DataFrame, keys: Sequence[str], gap_s: int = 3600) -> DataFrame:
    """Sessions from partial ones: each is a window from its first row to the gap behind its last, and these are merged."""
    seconds = (F.unix_micros("last_row") - F.unix_micros("first_row")).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    reach = F.make_interval(secs=(seconds + gap_s).cast("decimal(18,6)"))
    ends = [F.sum("rows").alias("rows"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row")]
    return parts.groupBy(*keys, F.session_window("first_row", reach).alias("w")).agg(*ends).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rows", "first_row", "last_row")


def read_sessions(spark: SparkSession, log_dir: str, kinds: T.StructType, keys: Sequence[str], gap_s: int = 3600) -> DataFrame:
    """All sessions so far, open ones included; ``kinds`` are the types of the keys."""
    times = [T.StructField(c, T.TimestampType()) for c in ("start", "end", "first_row", "last_row")]
    schema = T.StructType([*kinds.fields, *times, T.StructField("rows", T.LongType())])
    return merged_sessions(spark.read.schema(schema).parquet(log_dir), keys, gap_s)


def compact_sessions(spark: SparkSession, log_dir: str, to_dir: str, kinds: T.StructType, keys: Sequence[str], gap_s: int = 3600) -> None:
    """Write the merged log as batch -1 of a new log, which later micro-batches can go on from."""
    read_sessions(spark, log_dir, kinds, keys, gap_s).write.mode("overwrite").parquet(f"{to_dir}/batch=-1")
