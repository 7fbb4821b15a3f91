"""Live ingest, T1-T4 and S9-S11.

Each micro-batch writes its rows and status changes into a folder of its own number, so
a batch that is run again after a failure replaces what it wrote the first time.

Cleaning takes one session or file after the other with ``process``, or with ``process_all`` all that a
micro-batch closes or brings in one job, written once, partitioned by session or file.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from torqueline.functions.text import normalize_timestamp_key, parse_timestamp
from torqueline.operators.encode import map_to_columns
from torqueline.plans.cleaning import clean_session
from torqueline.sources.csv_logs import read_logs
from torqueline.sources.messages import stream_messages, with_arrival
from torqueline.sources.sinks import RAW_STORE, write_csv

STATUS = "session string, status string, batch long, seq struct<at:timestamp,file:string,block:long,line:long>, step int"


def control_split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Control messages (start, end) and data messages; a control message is never a row."""
    control = F.coalesce(F.col("status").isin("start", "end"), F.lit(False))
    return messages.filter(control), messages.filter(~control)


def raw_rows(messages: DataFrame) -> DataFrame:
    """Rows of the raw store: session key, normalised timestamp, label, open-ended readings."""
    _, data = control_split(messages)
    key = normalize_timestamp_key("timestamp")
    return data.select(key.alias("session"), key.alias("timestamp"), "driving_style", "data")


def status_rows(control: DataFrame, batch: int) -> DataFrame:
    """started for a start message; processed for an end message."""
    return control.select(
        "session", F.when(F.col("status") == "start", "started").otherwise("processed").alias("status"),
        F.lit(batch).cast("long").alias("batch"), "seq",
        F.when(F.col("status") == "start", 0).otherwise(1).alias("step"),
    )


def session_frame(store: DataFrame, session: str | None = None) -> DataFrame:
    """Wide, typed rows of one session, or of the whole store."""
    rows = store if session is None else store.filter(F.col("session") == session)
    return map_to_columns(rows.select(parse_timestamp("timestamp").alias("timestamp"), "driving_style", "data"))


def sessions_frame(store: DataFrame) -> DataFrame:
    """Wide, typed rows of all sessions of the store, with their session."""
    return map_to_columns(store.select("session", parse_timestamp("timestamp").alias("timestamp"), "driving_style", "data"))


def write_parts(df: DataFrame, path: str, key: str) -> None:
    """Write CSV by ``key``; what was written for the same keys before is replaced, all else stays."""
    write_csv(df, path, [key], only_parts=True)


def start_ingest(
    spark: SparkSession, in_dir: str, raw_dir: str, status_dir: str, checkpoint: str, cleaned_dir: str | None = None,
    all_history: bool = False, files_per_trigger: int | None = 100, available_now: bool = False,
    process: Callable[[DataFrame], DataFrame] = clean_session, process_all: Callable[[DataFrame, str], DataFrame] | None = None,
) -> StreamingQuery:
    """Watch ``in_dir`` for message files: store rows, track sessions, clean each closed one.

    With ``all_history`` an end message cleans the whole store, as the service this
    follows does; otherwise only the session it closes.  ``process_all`` (rows, key) replaces both: it cleans all
    closed sessions at once, each on its own, as :func:`~torqueline.plans.keyed.clean_sessions` does.
    """

    def handle(batch: DataFrame, number: int) -> None:
        batch = with_arrival(batch).persist()
        try:
            control, _ = control_split(batch)
            raw_rows(batch).write.mode("overwrite").parquet(f"{raw_dir}/batch={number}")
            changes = status_rows(control, number)
            changes.write.mode("overwrite").parquet(f"{status_dir}/batch={number}/part=control")
            if cleaned_dir is not None and process_all is not None:
                ended = control.filter("status = 'end'").select("session").distinct()
                rows = spark.read.schema(RAW_STORE).parquet(raw_dir).join(ended, "session", "left_semi")
                write_parts(process_all(sessions_frame(rows), "session"), cleaned_dir, "session")
            closed = [] if process_all is not None else [r["session"] for r in control.filter("status = 'end'").select("session").distinct().collect()]
            if cleaned_dir is not None and closed:
                store = spark.read.schema(RAW_STORE).parquet(raw_dir)
                for session in closed:
                    rows = session_frame(store, None if all_history else session)
                    write_csv(process(rows).orderBy("timestamp"), f"{cleaned_dir}/cleaned_{session}")
            done = changes.filter("status = 'processed'").withColumns({"status": F.lit("done"), "step": F.lit(2)})
            done.write.mode("overwrite").parquet(f"{status_dir}/batch={number}/part=done")
        finally:
            batch.unpersist()

    writer = (
        stream_messages(spark, in_dir, files_per_trigger).writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_status(spark: SparkSession, status_dir: str) -> DataFrame:
    return spark.read.schema(STATUS + ", part string").option("recursiveFileLookup", False).option(
        "basePath", status_dir).parquet(status_dir).drop("part")


def pipeline_status(changes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Latest status per session, without the removed ones."""
    place = F.struct("batch", "seq", "step")
    latest = changes.groupBy("session").agg(F.max_by("status", place).alias("status"))
    return latest if removed is None else latest.join(removed.select("session"), "session", "left_anti")


def start_csv_drop(
    spark: SparkSession, in_dir: str, cleaned_dir: str, status_dir: str, checkpoint: str,
    files_per_trigger: int | None = 100, available_now: bool = False,
    process: Callable[[DataFrame], DataFrame] = clean_session, process_all: Callable[[DataFrame, str], DataFrame] | None = None,
) -> StreamingQuery:
    """Clean every CSV that arrives on its own and record it as an event.

    The stream only announces files (their content is read by header group, as columns
    differ from file to file).  With ``process_all`` (rows, key) the files of a micro-batch, of which
    ``files_per_trigger`` bounds the number, are cleaned by one job.
    """
    reader = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv").schema(
        "path string, modificationTime timestamp, length long, content binary")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    arrivals = reader.load(in_dir).select("path", "modificationTime")

    def handle(batch: DataFrame, number: int) -> None:
        if process_all is not None:
            paths = [r["path"] for r in batch.select("path").collect()]
            if paths:
                logs = read_logs(spark, paths).drop("source_block", "row_no")
                write_parts(process_all(logs, "source_file"), cleaned_dir, "source_file")
            name = F.element_at(F.split("path", "/"), -1)
            steps = F.array(*[F.struct(F.lit(n).alias("step"), F.lit(x).alias("status")) for n, x in enumerate(("started", "processed", "done"))])
            zero = F.lit(0).cast("long")
            events = batch.select("modificationTime", name.alias("session"), F.explode(steps).alias("s")).select(
                "session", "s.status", F.lit(number).cast("long").alias("batch"),
                F.struct(F.col("modificationTime").alias("at"), F.col("session").alias("file"), zero.alias("block"), zero.alias("line")).alias("seq"), "s.step")
            events.write.mode("overwrite").parquet(f"{status_dir}/batch={number}/part=files")
            return
        events = []
        for row in batch.orderBy("modificationTime", "path").collect():
            name = row["path"].rsplit("/", 1)[-1]
            logs = read_logs(spark, row["path"], provenance=False)
            write_csv(process(logs).orderBy("timestamp"), f"{cleaned_dir}/cleaned_{name.removesuffix('.csv')}")
            for step, status in enumerate(("started", "processed", "done")):
                events.append((name, status, number, (row["modificationTime"], name, 0, 0), step))
        spark.createDataFrame(events, STATUS).write.mode("overwrite").parquet(f"{status_dir}/batch={number}/part=files")

    writer = arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def status_feed(changes: DataFrame) -> DataFrame:
    """Changes a watcher would see: only statuses that differ from the session's last one."""
    w = Window.partitionBy("session").orderBy("batch", "seq", "step")
    return changes.withColumn("__was", F.lag("status").over(w)).filter(
        ~F.col("status").eqNullSafe(F.col("__was"))).drop("__was")


def keep_latest(changes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest row per key by a pre-aggregated maximum."""
    cols = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("__r")).select(*keys, "__r.*")
