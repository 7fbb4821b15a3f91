"""S1-S14.  Each query writes a whole table in the form the source reads, then reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import EVENTS, LINE_KEY, drive_log, events, fleet, query, rounded, table
from torqueline.operators import ml
from torqueline.operators.joins import union_logs
from torqueline.plans.cleaning import clean_session
from torqueline.session import scratch_path
from torqueline.sources import csv_logs, messages, sinks

TEXT = {"event_type", "label", "source_file", "source_type"}


def written_logs(spark, sf):
    """Events as CSV folders with two headers (the second lacks ``x`` and moves ``value``)."""
    path = scratch_path(spark, "logs")
    e = events(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    first = e.filter("event_id % 2 = 0").select("timestamp", "event_id", "value", "x", "label")
    second = e.filter("event_id % 2 = 1").select("timestamp", "label", "value", "event_id")
    sinks.write_csv(first, f"{path}/drive")
    sinks.write_csv(second, f"{path}/idle")
    return path


def read(spark, path, **more):
    return csv_logs.read_logs(spark, f"{path}/*", "*.csv", text=TEXT, **more)


LOGS = f"""{EVENTS}, logs AS (SELECT ts AS timestamp, event_id::DOUBLE AS event_id, value, label,
  CASE WHEN event_id % 2 = 0 THEN x END AS x FROM ev)"""


@query("s1_csv_scan", f"WITH {LOGS} SELECT * FROM logs")
def s1(spark, sf):
    """Two headers in one folder: columns line up by name and types follow the declared names."""
    out = read(spark, written_logs(spark, sf), provenance=False)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("s2_header_signature", f"""
WITH {EVENTS}, h AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'timestamp,event_id,value,x,label' ELSE 'timestamp,label,value,event_id' END AS header FROM ev)
SELECT header, count(*) AS rows FROM h GROUP BY header""")
def s2(spark, sf):
    """Header of every file, next to the number of rows that were written under it."""
    path = written_logs(spark, sf)
    file = F.element_at(F.split("path", "/"), -1)
    heads = csv_logs.header_signature(spark, f"{path}/*").select(file.alias("file"), "header")
    lines = spark.read.text(f"{path}/*/*.csv").select(F.col("_metadata.file_name").alias("file"), "value")
    rows = lines.join(heads, "file").where(F.col("value") != F.col("header"))
    return rows.groupBy("header").agg(F.count(F.lit(1)).alias("rows"))


@query("s3_union_by_name", f"WITH {LOGS} SELECT count(*) AS rows, count(x) AS xs, count(label) AS labels, count(value) AS vals FROM logs")
def s3(spark, sf):
    out = read(spark, written_logs(spark, sf))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count("x").alias("xs"), F.count("label").alias("labels"),
                   F.count("value").alias("vals"))


@query("s4_union_common_columns", f"WITH {LOGS} SELECT * EXCLUDE (x) FROM logs")
def s4(spark, sf):
    out = read(spark, written_logs(spark, sf), how="common", provenance=False)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("s5_union_by_schema_group", """
SELECT 'event_id,value' AS header, count(*) AS rows, sum(event_id)::DOUBLE AS ids, round(sum(value), 4) AS total FROM events""")
def s5(spark, sf):
    path = scratch_path(spark, "groups")
    e = table(spark, sf, "events").select("event_id", "value")
    sinks.write_csv(e.repartition(2, "event_id"), f"{path}/a")
    sinks.write_csv(e.coalesce(1).withColumnRenamed("value", "SPEED"), f"{path}/b")
    groups = csv_logs.union_by_schema_group(spark, f"{path}/*", ts=None)
    # the second header is in one file only, so it makes no group
    frames = [df.withColumn("header", F.lit(",".join(c for c in df.columns if c != "source_file"))) for df in groups.values()]
    return union_logs(frames).groupBy("header").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


def named_files(df, folder, name):
    """Write a table as CSV files ``<name>_<n>.csv`` into a folder that others write to as well."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    part = scratch_path(spark, "part")
    sinks.write_csv(df, part)
    fs = place(part).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(folder))
    files = [f.getPath() for f in fs.listStatus(place(part)) if f.getPath().getName().endswith(".csv")]
    for n, file in enumerate(files):
        fs.rename(file, place(f"{folder}/{name}_{n}.csv"))


@query("s6_union_by_prefix_group", """
SELECT event_id::DOUBLE AS event_id, value, CASE event_type WHEN 'view' THEN 'drive' ELSE 'idle' END AS source_type
FROM events WHERE event_type IN ('view', 'click')""")
def s6(spark, sf):
    """Files named by event type: two prefixes that are listed, one that is not."""
    folder = scratch_path(spark, "prefix")
    e = table(spark, sf, "events")
    for kind, name in (("view", "drive"), ("click", "idle"), ("purchase", "other")):
        named_files(e.filter(F.col("event_type") == kind).select("event_id", "value"), folder, name)
    return csv_logs.union_by_prefix_group(spark, folder, ts=None).select("event_id", "value", "source_type")


@query("s7_file_filter", "SELECT count(*) AS rows FROM events WHERE event_id % 2 = 0")
def s7(spark, sf):
    """Only CSV parts of one folder, without the job's own output."""
    path = written_logs(spark, sf)
    e = table(spark, sf, "events").select("event_id", "value")
    e.write.json(f"{path}/json")
    out = csv_logs.read_logs(spark, f"{path}/drive", "part-*.csv", exclude=["merged*"], text=TEXT)
    return out.agg(F.count(F.lit(1)).alias("rows"))


@query("s8_file_inventory", """
SELECT kind || '.csv' AS file, n > 0 AS present, n AS rows FROM (
  SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'absent', 0)""")
def s8(spark, sf):
    """One file per event type; sizes come from the file system, rows from the files."""
    folder = scratch_path(spark, "inventory")
    e = table(spark, sf, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())
    for kind in kinds:
        named_files(e.filter(F.col("event_type") == kind).select("event_id").coalesce(1), folder, kind)
    plain = F.regexp_replace("file", "_0[.]csv$", ".csv").alias("file")
    listed = csv_logs.file_inventory(spark, folder, [f"{k}_0.csv" for k in [*kinds, "absent"]], "*.csv")
    rows = csv_logs.read_logs(spark, folder, ts=None).groupBy(F.col("source_file").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    both = listed.join(rows, listed["file"] == rows["of"], "left").withColumn("present", F.col("present") & (F.coalesce("size_mb", F.lit(0.0)) > 0))
    return both.select(plain, "present", F.coalesce("n", F.lit(0).cast("long")).alias("rows"))


def messages_of(spark, sf):
    """Events as ingest messages, one session per vehicle, written as JSON lines."""
    path = scratch_path(spark, "messages")
    e = drive_log(spark, sf)
    body = F.create_map(
        F.lit("RPM"), F.col("RPM").cast("string"), F.lit("SPEED"), F.col("SPEED").cast("string"),
        F.lit("THROTTLE_POS"), F.col("THROTTLE_POS").cast("string"))
    e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.lit("normal").alias("driving_style"),
             body.alias("data"), F.lit(None).cast("string").alias("status")).write.json(path)
    return path


@query("s9_json_message_source", f"""
WITH {EVENTS} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, 'normal' AS driving_style,
  NULL::VARCHAR AS status, value AS SPEED, 40 * k AS RPM FROM ev""")
def s9(spark, sf):
    m = messages.read_messages(spark, messages_of(spark, sf))
    return m.select("timestamp", "driving_style", "status", F.col("data")["SPEED"].cast("double").alias("SPEED"),
                    F.col("data")["RPM"].cast("double").alias("RPM"))


@query("s11_append_sink", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s11(spark, sf):
    path = scratch_path(spark, "store")
    e = table(spark, sf, "events")
    sinks.append_rows(e.filter("event_id % 2 = 0"), path)
    sinks.append_rows(e.filter("event_id % 2 = 1"), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("s12_csv_sink", "SELECT event_id, ts, event_type, value FROM events")
def s12(spark, sf):
    path = scratch_path(spark, "out")
    e = table(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    sinks.write_csv(e, path)
    return spark.read.schema(e.schema).option("header", True).csv(path)


@query("s12_csv_text", f"""
SELECT doc_id::DOUBLE AS doc_id, CASE WHEN text NOT IN ({', '.join(f"'{v}'" for v in csv_logs.MISSING)}) THEN text END AS text, lang
FROM (SELECT doc_id, text, lang FROM documents UNION ALL
  SELECT -1 - doc_id, CASE doc_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'said "hi", ok' WHEN 2 THEN ' a' || chr(10) || '"b" ' END, lang FROM documents)""")
def s12_text(spark, sf):
    """Whole documents, with commas, quotes, line ends, blanks and missing values, written and read back."""
    path = scratch_path(spark, "text")
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    n = F.col("doc_id") % 4
    odd = F.when(n == 0, "NA").when(n == 1, 'said "hi", ok').when(n == 2, ' a\n"b" ')
    sinks.write_csv(d.unionAll(d.select(-1 - F.col("doc_id"), odd, "lang")), path)
    return csv_logs.read_logs(spark, path, ts=None, text={"text", "lang"}, provenance=False)


@query("s13_empty_store_init", "SELECT user_id::VARCHAR AS session, count(*) AS rows, 0::BIGINT AS before, true AS created, false AS again FROM events GROUP BY 1")
def s13(spark, sf):
    """A new store is empty, is not made twice, and takes a table."""
    path = scratch_path(spark, "raw")
    made = sinks.init_store(spark, path)
    before = spark.read.schema(sinks.RAW_STORE).parquet(path).count()
    e = drive_log(spark, sf)
    sinks.append_rows(e.select(
        F.col("user_id").cast("string").alias("session"), F.col("ts").cast("string").alias("timestamp"), F.lit(None).cast("string").alias("driving_style"),
        F.create_map(F.lit("RPM"), F.col("RPM").cast("string")).alias("data")), path)
    again = sinks.init_store(spark, path)
    rows = spark.read.schema(sinks.RAW_STORE).parquet(path).groupBy("session").agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumns({"before": F.lit(before).cast("long"), "created": F.lit(made), "again": F.lit(again)})


@query("s14_model_sink", "SELECT count(*) AS rows, count(*) AS same FROM lineitem")
def s14(spark, sf):
    """A saved and reloaded model predicts what the fitted one does."""
    path = scratch_path(spark, "model")
    rows = fleet(spark, sf).select(*LINE_KEY, "ENGINE_LOAD", "MAF", "COOLANT_TEMP")
    model = ml.random_forest_regressor(rows, ["ENGINE_LOAD", "MAF"], "COOLANT_TEMP")
    ml.save_model(model, path)
    both = ml.predict(model, rows).withColumnRenamed("prediction", "before")
    both = ml.predict(ml.load_model(path), both)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") == F.col("prediction")).alias("same"))


@query("s10_csv_drop_source")
def s10(spark, sf):
    """Two arriving files, each cleaned on its own, with their final status."""
    from torqueline.streaming import ingest

    path = written_logs(spark, sf)
    base = scratch_path(spark, "drop")
    ingest.start_csv_drop(
        spark, f"{path}/*", f"{base}/cleaned", f"{base}/status", f"{base}/checkpoint", available_now=True,
        process=lambda df: clean_session(df.drop("label")),
    ).awaitTermination()
    return ingest.pipeline_status(ingest.read_status(spark, f"{base}/status"))
