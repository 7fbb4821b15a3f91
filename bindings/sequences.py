"""N1-N13 over the event log, per vehicle and over the whole log."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import DRIVE_LOG, EVENTS, SERIES, drive_log, events, query, rounded
from torqueline.operators import sequence as seq
from torqueline.operators.timeline import timeline
from torqueline.plans.driving import analyse_driving

# thresholds on rates suit rows that are hours apart; the absolute ones are the defaults
LIMITS = seq.Thresholds(braking_g=-0.0002, accelerating_g=0.0001, rpm_rate=0.5, throttle_rate=0.045)


def series(spark, sf, *cols):
    e = events(spark, sf).select("event_id", "user_id", "ts", *cols)
    return timeline(e, "ts", ["user_id"], ["event_id"])


GAP = "(epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE"


@query("n1_time_gap", f"""
WITH {EVENTS} SELECT event_id, round({GAP}, 6) AS time_diff FROM ev WINDOW w AS ({SERIES})""")
def n1(spark, sf):
    return rounded(seq.time_gap(series(spark, sf)).frame.select("event_id", "time_diff"))


@query("n2_delta", f"""
WITH {EVENTS} SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 6) AS step FROM ev WINDOW w AS ({SERIES})""")
def n2(spark, sf):
    return rounded(seq.delta(series(spark, sf, "value"), "value", "step").frame.select("event_id", "step"))


@query("n3_rate_of_change", f"""
WITH {EVENTS} SELECT event_id,
  round(coalesce((value - lag(value) OVER w) / nullif({GAP}, 0), 0), 6) AS value_rate,
  round(coalesce((k - lag(k) OVER w) / nullif({GAP}, 0), 0), 6) AS k_rate FROM ev WINDOW w AS ({SERIES})""")
def n3(spark, sf):
    tl = seq.time_gap(series(spark, sf, "value", "k"), "gap")
    out = seq.rates_of_change(tl, {"value_rate": "value", "k_rate": "k"}, "gap").frame
    return rounded(out.select("event_id", "value_rate", "k_rate"))


@query("n4_forward_fill", f"""
WITH {EVENTS} SELECT event_id, last_value(x IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS x
FROM ev WINDOW w AS ({SERIES})""")
def n4(spark, sf):
    return seq.forward_fill(series(spark, sf, "x"), ["x"]).frame.select("event_id", "x")


@query("n4_forward_fill_cut", f"""
WITH {EVENTS} SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x
FROM ev""")
def n4_cut(spark, sf):
    """The log as one series in slabs of about 500 rows."""
    e = events(spark, sf).select("event_id", "ts", "x")
    return seq.forward_fill(timeline(e, "ts", [], ["event_id"], rows_per_slab=500), ["x"]).frame.select("event_id", "x")


@query("n4_forward_fill_whole_log", f"""
WITH {EVENTS} SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS x
FROM ev""")
def n4_whole(spark, sf):
    e = events(spark, sf).select("event_id", "ts", "x")
    return seq.forward_fill(timeline(e, "ts", [], ["event_id"]), ["x"]).frame.select("event_id", "x")


@query("n5_hold_last_multirate", f"""
WITH {EVENTS}, p AS (
  SELECT event_id, user_id, ts, event_type,
         CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM ev),
h AS (SELECT event_id,
  max(CASE WHEN event_type = 'click' THEN event_id END) OVER w AS c,
  max(CASE WHEN event_type = 'view' THEN event_id END) OVER w AS d
  FROM p WINDOW w AS ({SERIES} ROWS UNBOUNDED PRECEDING))
SELECT h.event_id, pc.v AS click, pd.v AS view
FROM h LEFT JOIN p pc ON pc.event_id = h.c LEFT JOIN p pd ON pd.event_id = h.d""")
def n5(spark, sf):
    """Each event polls the signal named by its type; every seventh poll gets no answer."""
    polls = events(spark, sf).select("event_id", "user_id", "ts", F.col("event_type").alias("signal"), F.col("x").alias("value"))
    rows = seq.polled_rows(polls, ["event_id", "user_id", "ts"], ["click", "view"])
    return seq.hold_last_multirate(timeline(rows, "ts", ["user_id"], ["event_id"]), ["click", "view"]).frame.select(
        "event_id", "click", "view")


@query("n6_rolling_std", f"""
WITH {EVENTS} SELECT event_id, round(coalesce(stddev_samp(x) OVER (w ROWS 2 PRECEDING), 0), 4) AS std
FROM ev WINDOW w AS ({SERIES})""")
def n6(spark, sf):
    return rounded(seq.rolling_std(series(spark, sf, "x"), "x", "std").frame.select("event_id", "std"), 4)


SESSIONS = f"""g AS (SELECT *, {GAP} AS gap FROM ev WINDOW w AS ({SERIES})),
s AS (SELECT *, CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS BIGINT)
      AS new_session FROM g)"""


@query("n7_sessionize_gap", f"WITH {EVENTS}, {SESSIONS} SELECT event_id, new_session FROM s")
def n7(spark, sf):
    return seq.sessionize(series(spark, sf), 21_600).frame.select("event_id", "new_session")


RUNS = f"""f AS (SELECT *, value < 20 AS zero FROM ev),
t AS (SELECT *, zero <> coalesce(lag(zero) OVER ({SERIES}), false) AS turn FROM f),
r AS (SELECT *, CAST(sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM t)"""


@query("n8_run_ids", f"WITH {EVENTS}, {RUNS} SELECT event_id, run_id FROM r")
def n8(spark, sf):
    return seq.run_ids(series(spark, sf, "value"), F.col("value") < 20).frame.select("event_id", "run_id")


@query("n9_idle_runs", f"""
WITH {EVENTS}, {RUNS}, d AS (SELECT *, (epoch_us(max(ts) OVER (PARTITION BY user_id, run_id))
   - epoch_us(min(ts) OVER (PARTITION BY user_id, run_id))) / 1e6::DOUBLE AS secs FROM r)
SELECT event_id, CASE WHEN zero AND secs >= 36000 THEN 'idle' ELSE label END AS style FROM d""")
def n9(spark, sf):
    e = events(spark, sf).select(
        "event_id", "user_id", "ts", F.col("label").alias("style"),
        F.when(F.col("value") < 20, 0.0).otherwise(F.col("value")).alias("SPEED"))
    tl = timeline(e, "ts", ["user_id"], ["event_id"])
    return seq.idle_runs(tl, "SPEED", 36_000, "style").frame.select("event_id", "style")


@query("n10_row_index_cut", f"""
WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM ev""")
def n10_cut(spark, sf):
    """One series in slabs of about 200 rows, numbered through."""
    e = events(spark, sf).select("event_id", "ts")
    return seq.row_index(timeline(e, "ts", [], ["event_id"], rows_per_slab=200)).frame.select("event_id", "row_index")


@query("n10_row_index", f"""
WITH {EVENTS} SELECT event_id, row_number() OVER ({SERIES}) - 1 AS row_index FROM ev""")
def n10(spark, sf):
    return seq.row_index(series(spark, sf)).frame.select("event_id", "row_index")


@query("n10_row_index_whole_log", f"""
WITH {EVENTS} SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM ev""")
def n10_whole(spark, sf):
    e = events(spark, sf).select("event_id", "ts")
    return seq.row_index(timeline(e, "ts", [], ["event_id"])).frame.select("event_id", "row_index")


STYLES = f"""a AS (SELECT *, coalesce((SPEED - lag(SPEED) OVER w) * (1 / 3.6::DOUBLE) / nullif({GAP}, 0), 0) / 9.80665 AS g,
  coalesce((RPM - lag(RPM) OVER w) / nullif({GAP}, 0), 0) AS rr,
  coalesce((THROTTLE_POS - lag(THROTTLE_POS) OVER w) / nullif({GAP}, 0), 0) AS tr
  FROM log WINDOW w AS ({SERIES})),
m AS (SELECT *, SPEED > 2 AS moving,
  SPEED > 2 AND (g < -0.0002 OR (RPM > 2700 AND THROTTLE_POS > 40) OR (g > 0.0001 AND (rr > 0.5 OR tr > 0.045))) AS event,
  RPM > 2300 AND SPEED > 2 AS holds FROM a),
l AS (SELECT *, coalesce(last_value(CASE WHEN event THEN true WHEN NOT holds THEN false END IGNORE NULLS)
  OVER ({SERIES} ROWS UNBOUNDED PRECEDING), false) AS aggressive FROM m),
styled AS (SELECT *, CASE WHEN aggressive THEN 'Aggressive'
  WHEN moving AND (RPM > 2100 OR THROTTLE_POS > 25) THEN 'Moderate' ELSE 'Passive' END AS style FROM l)"""


@query("n11_driving_style_latch", f"WITH {EVENTS}, {DRIVE_LOG}, {STYLES} SELECT event_id, style FROM styled")
def n11(spark, sf):
    out = analyse_driving(drive_log(spark, sf), "ts", ["user_id"], ["event_id"], LIMITS)
    return out.select("event_id", F.col("driving_style_analyzed").alias("style"))


@query("n11_driving_style_latch_cut", f"WITH {EVENTS}, {DRIVE_LOG}, {STYLES} SELECT event_id, style FROM styled")
def n11_cut(spark, sf):
    """Series cut at about 40 rows."""
    out = analyse_driving(drive_log(spark, sf), "ts", ["user_id"], ["event_id"], LIMITS, rows_per_slab=40)
    return out.select("event_id", F.col("driving_style_analyzed").alias("style"))


@query("n12_gap_report", f"""
WITH {EVENTS}, g AS (SELECT {GAP} AS gap FROM ev WINDOW w AS ({SERIES}))
SELECT count(*) AS rows, count(*) FILTER (gap > 21600) AS gaps_over, round(max(gap), 4) AS max_gap,
       round(avg(gap), 4) AS mean_gap, round(min(gap), 4) AS min_gap FROM g""")
def n12(spark, sf):
    return rounded(seq.gap_report(series(spark, sf), 21_600), 4)


@query("n13_status_change", f"""
WITH {EVENTS}, c AS (SELECT event_id, label, lag(label) OVER w AS was, row_number() OVER w AS rn
  FROM ev WINDOW w AS ({SERIES}))
SELECT event_id, label FROM c WHERE rn = 1 OR label IS DISTINCT FROM was""")
def n13(spark, sf):
    return seq.status_change(series(spark, sf, "label"), "label").select("event_id", "label")


@query("g1_run_summary", f"""
WITH {EVENTS}, {RUNS}
SELECT user_id, run_id, min(zero) AS zero, min(ts) AS start_time, max(ts) AS end_time,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 6) AS duration_sec FROM r GROUP BY user_id, run_id""")
def g1(spark, sf):
    tl = seq.run_ids(series(spark, sf, "value"), F.col("value") < 20)
    rows = tl.frame.withColumn("zero", F.col("value") < 20)
    return rounded(seq.run_summary(rows, ["user_id", "run_id"], "ts", "zero"))
