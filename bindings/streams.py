"""T1-T6 on file streams that run until the input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import DRIVE_LOG, EVENTS, drive_log, events, query, rounded, table
from bindings.sequences import LIMITS, STYLES
from torqueline.plans import keyed
from torqueline.session import scratch_path
from torqueline.sources import messages
from torqueline.streaming import driving, ingest, sessions


def session_messages(spark, sf):
    """One message per event, session named by the event type, with start and end messages.

    Start and end messages come from the table too: its first and last event of each type.
    """
    e = events(spark, sf)
    key = F.concat(F.lit("2024-01-01 "), F.col("event_type"))
    data = e.select(
        key.alias("timestamp"), F.col("event_type").alias("driving_style"),
        F.create_map(F.lit("RPM"), (40 * F.col("k")).cast("string"), F.lit("SPEED"), F.col("value").cast("string"),
                     F.lit("EVENT"), F.col("event_id").cast("string")).alias("data"),
        F.lit(None).cast("string").alias("status"))
    ends = e.groupBy("event_type").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    control = ends.select(
        F.concat(F.lit("2024-01-01 "), "event_type").alias("timestamp"), F.lit("none").alias("driving_style"),
        F.create_map().cast("map<string,string>").alias("data"),
        F.explode(F.when(F.col("event_type") != "error", F.array(F.lit("start"), F.lit("end"))).otherwise(
            F.array(F.lit("start")))).alias("status"))
    path = scratch_path(spark, "stream")
    control.filter("status = 'start'").write.mode("append").json(path)
    data.write.mode("append").json(path)
    control.filter("status = 'end'").write.mode("append").json(path)
    return path


def run_ingest(spark, sf):
    base = scratch_path(spark, "ingest")
    ingest.start_ingest(
        spark, session_messages(spark, sf), f"{base}/raw", f"{base}/status", f"{base}/checkpoint",
        cleaned_dir=f"{base}/cleaned", available_now=True, process=lambda df: df.select("timestamp", "RPM", "SPEED"),
    ).awaitTermination()
    return base


@query("t1_control_split", "SELECT event_type AS session, count(*) AS rows FROM events GROUP BY 1")
def t1(spark, sf):
    """Control messages are not stored as rows."""
    _, data = ingest.control_split(messages.read_messages(spark, session_messages(spark, sf)))
    return data.groupBy(F.col("driving_style").alias("session")).agg(F.count(F.lit(1)).alias("rows"))


@query("t2_append_ingest", f"""
WITH {EVENTS} SELECT '2024-01-01T' || event_type AS session, event_type AS driving_style, event_id, 40 * k AS RPM FROM ev""")
def t2(spark, sf):
    raw = spark.read.parquet(f"{run_ingest(spark, sf)}/raw")
    return raw.select("session", "driving_style", F.col("data")["EVENT"].cast("long").alias("event_id"),
                      F.col("data")["RPM"].cast("double").alias("RPM"))


@query("t3_process_on_end", """
SELECT 'cleaned_2024-01-01T' || event_type AS session, count(*) AS rows FROM events WHERE event_type <> 'error' GROUP BY 1""")
def t3(spark, sf):
    """Each closed session has been cleaned on its own; the open one has not."""
    out = spark.read.option("header", True).csv(f"{run_ingest(spark, sf)}/cleaned/*")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return out.groupBy(name.alias("session")).agg(F.count(F.lit(1)).alias("rows"))


SIGNALS = ["SPEED", "RPM", "THROTTLE_POS"]


def keyed_sql() -> str:
    """Session cleaning of every vehicle on its own; a column that a vehicle loses is null."""
    live = " + ".join(f"live_{c}::INT" for c in SIGNALS)
    lacking = " + ".join(f"(live_{c} AND {c} IS NULL)::INT" for c in SIGNALS)
    return f"""
WITH {EVENTS}, {DRIVE_LOG},
a AS (SELECT user_id, ts, {", ".join(SIGNALS)}, {", ".join(f"min({c}) OVER w < max({c}) OVER w AS live_{c}" for c in SIGNALS)} FROM log WINDOW w AS (PARTITION BY user_id)),
b AS (SELECT DISTINCT user_id, ts, {", ".join(f"CASE WHEN live_{c} THEN {c} END AS {c}, live_{c}" for c in SIGNALS)} FROM a),
c AS (SELECT user_id, ts, {", ".join(f"CASE WHEN {c} NOT IN (-22, -40, 255) THEN {c} END AS {c}, live_{c}" for c in SIGNALS)} FROM b),
d AS (SELECT * FROM c WHERE {lacking} <= floor(0.8 * ({live}))),
e AS (SELECT user_id, ts, {", ".join(f"{c}, live_{c} AND count({c}) OVER w >= 0.2 * count(*) OVER w AS live_{c}" for c in SIGNALS)} FROM d WINDOW w AS (PARTITION BY user_id)),
f AS (SELECT user_id, ts, {", ".join(f"CASE WHEN live_{c} THEN {c} END AS {c}" for c in SIGNALS)} FROM e),
g AS (SELECT user_id, ts, SPEED, CASE WHEN RPM BETWEEN 100 AND 6000 THEN RPM END AS RPM, THROTTLE_POS FROM f
  WHERE {" + ".join(f"({c} IS NOT NULL)::INT" for c in SIGNALS)} >= 2),
h AS (SELECT user_id, {", ".join(f"median({c}) AS m_{c}, min({c}) AS a_{c}, max({c}) AS b_{c}" for c in SIGNALS)} FROM g GROUP BY user_id)
SELECT user_id, ts, {", ".join(f"round(CASE WHEN a_{c} = b_{c} THEN 0 ELSE (coalesce({c}, m_{c}) - a_{c}) / (b_{c} - a_{c}) END, 6) AS {c}" for c in SIGNALS)}
FROM g JOIN h USING (user_id)"""


@query("t3_clean_all_sessions", keyed_sql())
def t3_all(spark, sf):
    """The log of every vehicle cleaned on its own, all in one go."""
    out = keyed.clean_sessions(drive_log(spark, sf).select("user_id", "ts", *SIGNALS), "user_id", "ts", ("ts",))
    return rounded(out.select("user_id", "ts", *SIGNALS), 6)


@query("t4_session_status", """
SELECT DISTINCT '2024-01-01T' || event_type AS session, CASE WHEN event_type = 'error' THEN 'started' ELSE 'done' END AS status
FROM events WHERE event_type <> 'view'""")
def t4(spark, sf):
    changes = ingest.read_status(spark, f"{run_ingest(spark, sf)}/status")
    removed = table(spark, sf, "events").filter("event_type = 'view'").select(
        F.concat(F.lit("2024-01-01T"), "event_type").alias("session")).distinct()
    return ingest.pipeline_status(changes, removed)


@query("t5_driving_style_stream", f"WITH {EVENTS}, {DRIVE_LOG}, {STYLES} SELECT event_id, style FROM styled")
def t5(spark, sf):
    """The log arrives in four time slices, one micro-batch each."""
    base = scratch_path(spark, "drive")
    log = drive_log(spark, sf)
    day = F.dayofmonth("ts")
    for lo, hi in ((1, 8), (9, 16), (17, 24), (25, 31)):
        log.filter(day.between(lo, hi)).coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    driving.start_driving_stream(
        rows, f"{base}/out", f"{base}/late", f"{base}/state", f"{base}/checkpoint", ["user_id"], "ts", ["event_id"],
        LIMITS, available_now=True,
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", F.col("driving_style_analyzed").alias("style"))


SESSION_SQL = """
WITH g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 6 HOUR AS jump FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN jump THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS rows, min(ts) AS first_row, max(ts) AS last_row
FROM s GROUP BY user_id, n"""


def as_plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end", "first_row", "last_row")})


@query("t6_session_window", SESSION_SQL)
def t6(spark, sf):
    return as_plain(sessions.session_window_stream(table(spark, sf, "events"), "ts", ["user_id"], 21_600))


@query("t6_session_window_stream", SESSION_SQL)
def t6_stream(spark, sf):
    """All sessions, open ones included, after rows that arrive in mixed order, so that batches split and bridge them."""
    base = scratch_path(spark, "sessions")
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    for part in range(4):
        e.filter(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    rows = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    sessions.start_session_log(rows, f"{base}/log", f"{base}/checkpoint", "ts", ["user_id"], 21_600, available_now=True).awaitTermination()
    return as_plain(sessions.read_sessions(spark, f"{base}/log", e.select("user_id").schema, ["user_id"], 21_600))
