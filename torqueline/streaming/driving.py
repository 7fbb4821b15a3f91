"""Driving style while rows arrive, T5.

A micro-batch is analysed by the batch job itself: the last known row of each vehicle it
touches is put in front as a seed, so gaps, fills, rates and the aggressive state go on
where the previous batch stopped, and a vehicle that dominates a batch is cut into slabs
like in any other run.  The last rows live in a table of their own, one folder per
batch, with a full copy every ``SNAPSHOT_EVERY`` batches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from torqueline.operators.sequence import AGGRESSIVE, Thresholds
from torqueline.operators.timeline import ROWS_PER_SLAB
from torqueline.plans.driving import SIGNALS, analyse_driving, numeric_signals
from torqueline.sources.sinks import store_exists
from torqueline.streaming.ingest import keep_latest

SNAPSHOT_EVERY = 20


def _state_before(spark, state_dir: str, number: int) -> DataFrame | None:
    """State rows of all batches since the last full copy before ``number``."""
    first = max(0, (number - 1) // SNAPSHOT_EVERY * SNAPSHOT_EVERY)
    paths = [p for n in range(first, number) if store_exists(spark, p := f"{state_dir}/batch={n}")]
    return spark.read.option("basePath", state_dir).parquet(*paths) if paths else None


def analyse_batch(rows: DataFrame, state: DataFrame | None, ts: str, keys: Sequence[str], tie: Sequence[str],
                  limits: Thresholds, rows_per_slab: int = ROWS_PER_SLAB) -> tuple[DataFrame, DataFrame]:
    """(analysed rows, rows that came too late)."""
    rows = numeric_signals(rows, ts)
    place = [ts, *tie]
    unseeded = {"__seed": F.lit(False), "__known": F.lit(None).cast("boolean")}
    if state is None:
        joined, late = rows.withColumns(unseeded), rows.limit(0)
    else:
        last = state.select(*keys, F.struct(*place).alias("__last"))
        marked = rows.join(last, list(keys), "left")
        behind = F.coalesce(F.struct(*place) <= F.col("__last"), F.lit(False))
        late = marked.filter(behind).drop("__last")
        seeds = state.join(rows.select(*keys).distinct(), list(keys), "left_semi").select(
            *keys, *place, *SIGNALS, F.lit(True).alias("__seed"), F.col("aggressive").alias("__known"))
        joined = marked.filter(~behind).drop("__last").withColumns(unseeded).unionByName(seeds, allowMissingColumns=True)
    done = analyse_driving(joined, ts, keys, tie, limits, rows_per_slab, known_state="__known")
    return done.filter(~F.col("__seed")).drop("__seed", "__known"), late


def last_rows(done: DataFrame, ts: str, keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """What the next batch has to know of each vehicle."""
    state = done.select(*keys, ts, *tie, *SIGNALS, (F.col("driving_style_analyzed") == AGGRESSIVE).alias("aggressive"))
    return keep_latest(state, keys, [ts, *tie])


def start_driving_stream(
    readings: DataFrame, out_dir: str, late_dir: str, state_dir: str, checkpoint: str, keys: Sequence[str],
    ts: str = "timestamp", tie: Sequence[str] = (), limits: Thresholds = Thresholds(), available_now: bool = False,
) -> StreamingQuery:
    spark = readings.sparkSession

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            known = _state_before(spark, state_dir, number)
            known = None if known is None else keep_latest(known, keys, ["batch"])
            done, late = analyse_batch(batch, known, ts, keys, tie, limits)
            out = f"{out_dir}/batch={number}"
            done.write.mode("overwrite").parquet(out)
            late.write.mode("overwrite").parquet(f"{late_dir}/batch={number}")
            # the state follows from the rows just written, without analysing them again
            state = last_rows(spark.read.schema(done.schema).parquet(out), ts, keys, tie)
            if known is not None and number % SNAPSHOT_EVERY == 0:
                both = known.select(*state.columns, "batch").unionByName(state.withColumn("batch", F.lit(number)))
                state = keep_latest(both, keys, ["batch"]).drop("batch")
            state.write.mode("overwrite").parquet(f"{state_dir}/batch={number}")
        finally:
            batch.unpersist()

    writer = readings.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
