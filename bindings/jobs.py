"""K1-K14."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from bindings.base import (
    DRIVE_LOG, EVENTS, FLEET, LINE_KEY, SERIES, drive_log, events, fleet, query, rounded, table,
)
from bindings.models import gaps_filled, gaps_sql, with_gaps
from bindings.sequences import GAP, LIMITS, STYLES
from torqueline.operators.profile import correlation, describe_numeric
from torqueline.plans import cleaning, driving, fleet as fleet_plan, labelling, training


def raw_session(spark, sf):
    """Events as a raw session log: constant, repeated and sparse sensors, sentinels, odd engine speeds."""
    e = events(spark, sf)
    return e.select(
        F.col("ts").alias("timestamp"), F.col("label").alias("driving_style"),
        (80 * F.col("k")).alias("RPM"), F.col("s").alias("ENGINE_LOAD"), F.col("s").alias("LOAD_AGAIN"),
        F.col("x").alias("ABSOLUTE_LOAD"), F.lit(18.0).alias("BAROMETRIC_PRESSURE"),
        F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("O2_B1S2"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") / 10 + F.col("k")).alias("MAF"),
    )


SESSION = f"""{EVENTS}, raw AS (
  SELECT DISTINCT ts AS timestamp, label AS driving_style, 80 * k AS RPM,
    CASE WHEN s NOT IN (-22, -40, 255) THEN s END AS ENGINE_LOAD, CASE WHEN x NOT IN (-22, -40, 255) THEN x END AS ABSOLUTE_LOAD,
    CASE WHEN event_id % 10 = 0 AND value NOT IN (-22, -40, 255) THEN value END AS O2_B1S2,
    CASE WHEN event_id % 3 <> 0 AND value / 10 + k NOT IN (-22, -40, 255) THEN value / 10 + k END AS MAF FROM ev),
kept AS (SELECT timestamp, driving_style, CASE WHEN RPM IN (255) THEN NULL ELSE RPM END AS RPM, ENGINE_LOAD, ABSOLUTE_LOAD, MAF FROM raw
  WHERE (driving_style IS NULL)::INT + (RPM IS NULL)::INT + (ENGINE_LOAD IS NULL)::INT + (ABSOLUTE_LOAD IS NULL)::INT
      + (O2_B1S2 IS NULL)::INT + (MAF IS NULL)::INT <= 4),
ranged AS (SELECT * REPLACE (CASE WHEN RPM BETWEEN 100 AND 6000 THEN RPM END AS RPM) FROM kept
  WHERE (driving_style IS NOT NULL)::INT + (RPM IS NOT NULL)::INT + (ENGINE_LOAD IS NOT NULL)::INT
      + (ABSOLUTE_LOAD IS NOT NULL)::INT + (MAF IS NOT NULL)::INT > 1),
med AS (SELECT median(RPM) AS r, median(ENGINE_LOAD) AS e, median(ABSOLUTE_LOAD) AS a, median(MAF) AS m FROM ranged),
filled AS (SELECT timestamp, driving_style, coalesce(RPM, r) AS RPM, coalesce(ENGINE_LOAD, e) AS ENGINE_LOAD,
  coalesce(ABSOLUTE_LOAD, a) AS ABSOLUTE_LOAD, coalesce(MAF, m) AS MAF FROM ranged, med),
scaled AS (SELECT timestamp, driving_style, (RPM - min(RPM) OVER ()) / (max(RPM) OVER () - min(RPM) OVER ()) AS RPM,
  (ENGINE_LOAD - min(ENGINE_LOAD) OVER ()) / (max(ENGINE_LOAD) OVER () - min(ENGINE_LOAD) OVER ()) AS ENGINE_LOAD,
  (ABSOLUTE_LOAD - min(ABSOLUTE_LOAD) OVER ()) / (max(ABSOLUTE_LOAD) OVER () - min(ABSOLUTE_LOAD) OVER ()) AS ABSOLUTE_LOAD,
  (MAF - min(MAF) OVER ()) / (max(MAF) OVER () - min(MAF) OVER ()) AS MAF FROM filled),
cleaned AS (SELECT *, (ENGINE_LOAD + ABSOLUTE_LOAD) / 2 AS AVG_ENGINE_LOAD, MAF / nullif(RPM, 0) AS AIRFLOW_PER_RPM FROM scaled)"""


@query("k1_clean_session", f"""
WITH {SESSION} SELECT timestamp, driving_style, round(RPM, 6) AS RPM, round(ENGINE_LOAD, 6) AS ENGINE_LOAD,
  round(ABSOLUTE_LOAD, 6) AS ABSOLUTE_LOAD, round(MAF, 6) AS MAF, round(AVG_ENGINE_LOAD, 6) AS AVG_ENGINE_LOAD,
  round(AIRFLOW_PER_RPM, 6) AS AIRFLOW_PER_RPM FROM cleaned""")
def k1(spark, sf):
    return rounded(cleaning.clean_session(raw_session(spark, sf)))


@query("k1_session_correlation", f"""
WITH {SESSION} SELECT a.n AS x, b.n AS y, round(CASE
  {" ".join(f"WHEN a.n = '{p}' AND b.n = '{q}' THEN corr({p}, {q})" for p in ("RPM", "ENGINE_LOAD", "MAF") for q in ("RPM", "ENGINE_LOAD", "MAF"))}
  END, 6) AS r FROM cleaned, (SELECT unnest(['RPM', 'ENGINE_LOAD', 'MAF']) AS n) a, (SELECT unnest(['RPM', 'ENGINE_LOAD', 'MAF']) AS n) b
GROUP BY a.n, b.n""")
def k1_correlation(spark, sf):
    cleaned = cleaning.clean_session(raw_session(spark, sf))
    return rounded(correlation(cleaned, ["RPM", "ENGINE_LOAD", "MAF"]))


@query("k1_trend_table", f"""
WITH {SESSION} SELECT row_number() OVER (ORDER BY timestamp) - 1 AS sample, round(RPM, 6) AS RPM,
  round(ENGINE_LOAD, 6) AS ENGINE_LOAD, round(ABSOLUTE_LOAD, 6) AS ABSOLUTE_LOAD FROM cleaned""")
def k1_trend(spark, sf):
    return rounded(cleaning.trend_table(cleaning.clean_session(raw_session(spark, sf))))


TRIALS = f"""{EVENTS}, raw AS (
  SELECT DISTINCT ts AS timestamp, 80 * k AS RPM, CASE WHEN s NOT IN (-22, -40, 255) THEN s END AS ENGINE_LOAD,
    CASE WHEN x NOT IN (-22, -40, 255) THEN x END AS ABSOLUTE_LOAD FROM ev),
m1 AS (SELECT median(RPM) AS r, median(ENGINE_LOAD) AS e, median(ABSOLUTE_LOAD) AS a FROM raw),
f1 AS (SELECT timestamp, coalesce(RPM, r) AS RPM, coalesce(ENGINE_LOAD, e) AS ENGINE_LOAD, coalesce(ABSOLUTE_LOAD, a) AS ABSOLUTE_LOAD FROM raw, m1),
f2 AS (SELECT * REPLACE (CASE WHEN RPM BETWEEN 100 AND 6000 THEN RPM END AS RPM) FROM f1),
f3 AS (SELECT * REPLACE (coalesce(RPM, (SELECT median(RPM) FROM f2)) AS RPM) FROM f2),
b AS (SELECT min(RPM) AS rl, max(RPM) AS rh, min(ENGINE_LOAD) AS el, max(ENGINE_LOAD) AS eh, min(ABSOLUTE_LOAD) AS al, max(ABSOLUTE_LOAD) AS ah FROM f3),
cleaned AS (SELECT timestamp, (RPM - rl) / (rh - rl) AS RPM, (ENGINE_LOAD - el) / (eh - el) AS ENGINE_LOAD,
  (ABSOLUTE_LOAD - al) / (ah - al) AS ABSOLUTE_LOAD FROM f3, b)"""


def trials(spark, sf):
    """Three trial logs with different columns; the shared ones include a constant."""
    e = events(spark, sf)
    base = [F.col("ts").alias("timestamp"), (80 * F.col("k")).alias("RPM"), F.col("s").alias("ENGINE_LOAD"),
            F.col("x").alias("ABSOLUTE_LOAD"), F.lit(54.0).alias("FUEL_PRESSURE")]
    return [
        e.filter("event_id % 3 = 0").select(*base, F.col("value").alias("SPEED")),
        e.filter("event_id % 3 = 1").select(*base),
        e.filter("event_id % 3 = 2").select(*base, F.col("value").alias("MAF")),
    ]


@query("k2_clean_trials", f"""
WITH {TRIALS} SELECT timestamp, round(RPM, 6) AS RPM, round(ENGINE_LOAD, 6) AS ENGINE_LOAD, round(ABSOLUTE_LOAD, 6) AS ABSOLUTE_LOAD,
  round((ENGINE_LOAD + ABSOLUTE_LOAD) / 2, 6) AS AVG_ENGINE_LOAD FROM cleaned""")
def k2(spark, sf):
    return rounded(cleaning.clean_trials(trials(spark, sf)))


@query("k2_trial_summary", f"""
WITH {TRIALS} SELECT 'RPM' AS "column", count(RPM) AS count, round(avg(RPM), 6) AS mean, round(stddev_samp(RPM), 6) AS std,
  round(median(RPM), 6) AS q50 FROM cleaned UNION ALL SELECT 'ENGINE_LOAD', count(ENGINE_LOAD), round(avg(ENGINE_LOAD), 6),
  round(stddev_samp(ENGINE_LOAD), 6), round(median(ENGINE_LOAD), 6) FROM cleaned""")
def k2_summary(spark, sf):
    out = describe_numeric(cleaning.clean_trials(trials(spark, sf)), ["RPM", "ENGINE_LOAD"])
    return rounded(out.select("column", "count", "mean", "std", "q50"))


def session_rows(spark, sf):
    e = events(spark, sf)
    return e.select(
        "event_id", "user_id", F.col("ts").alias("timestamp"), F.col("label").alias("driving_style"),
        F.when(F.col("value") < 20, 0.0).otherwise(F.col("x")).alias("SPEED"), (40 * F.col("k")).alias("RPM"),
    )


LABELLED = f"""{EVENTS}, rows AS (
  SELECT event_id, user_id, ts, CASE WHEN value < 20 THEN 0 ELSE x END AS SPEED, 40 * k AS RPM, label AS driving_style FROM ev),
g AS (SELECT *, {GAP} AS gap, coalesce(SPEED = 0, false) AS zero FROM rows WINDOW w AS ({SERIES})),
t AS (SELECT *, zero <> coalesce(lag(zero) OVER ({SERIES}), false) AS turn FROM g),
r AS (SELECT *, sum(CASE WHEN turn THEN 1 ELSE 0 END) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS run_id,
  CAST(sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER ({SERIES} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS new_session FROM t),
labelled AS (SELECT event_id, user_id, ts, SPEED, RPM, gap, new_session, CASE WHEN zero
  AND epoch_us(max(ts) OVER (PARTITION BY user_id, run_id)) - epoch_us(min(ts) OVER (PARTITION BY user_id, run_id)) >= 36000000000
  THEN 'idle' ELSE driving_style END AS style FROM r)"""


@query("k3_label_sessions", f"""
WITH {LABELLED} SELECT event_id, round(gap, 6) AS time_diff, new_session, style FROM labelled""")
def k3(spark, sf):
    out = labelling.label_sessions(session_rows(spark, sf), "timestamp", ["user_id"], ["event_id"], session_gap_s=21_600, idle_s=36_000)
    return rounded(out.select("event_id", "time_diff", "new_session", F.col("driving_style").alias("style")))


def feature_rows(spark, sf):
    e = events(spark, sf)
    return e.select(
        "event_id", "user_id", "ts", F.col("label").alias("driving_style"), (40 * F.col("k")).alias("RPM"),
        F.col("x").alias("SPEED"), F.least(2 * F.col("value"), F.lit(100.0)).alias("THROTTLE_POS"),
        F.col("value").alias("ENGINE_LOAD"), F.col("x").alias("MAF"), F.col("k").alias("INTAKE_PRESSURE"))


@query("k4_driver_features", f"""
WITH {EVENTS}, f AS (SELECT event_id, user_id, ts, label, 40 * k AS RPM, least(2 * value, CAST(100 AS DOUBLE)) AS T, value AS L, k AS P,
  last_value(x IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS S FROM ev WINDOW w AS ({SERIES})),
d AS (SELECT * FROM f WHERE S IS NOT NULL),
b AS (SELECT min(S) AS sl, max(S) AS sh, min(RPM) AS rl, max(RPM) AS rh FROM d),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM d WHERE label IS NOT NULL))
SELECT event_id, user_id, ts, T AS THROTTLE_POS, P AS INTAKE_PRESSURE, round(RPM / (S + 0.001::DOUBLE), 3) AS RPM_per_speed,
  round(T / (RPM + 0.001::DOUBLE), 4) AS throttle_per_rpm, round(coalesce(stddev_samp(S) OVER (w ROWS 2 PRECEDING), 0), 4) AS speed_rolling_std,
  round(coalesce(T - lag(T) OVER w, 0), 4) AS delta_throttle, round((L + S) / 2, 4) AS engine_activity,
  round(((S - sl) / (sh - sl) + (RPM - rl) / (rh - rl)) / 2, 4) AS speed_rpm_index, label AS driving_style,
  CAST(coalesce(code, -1) AS INTEGER) AS driving_style_code
FROM d CROSS JOIN b LEFT JOIN c USING (label) WINDOW w AS ({SERIES})""")
def k4(spark, sf):
    out = labelling.driver_features(feature_rows(spark, sf), "ts", ["user_id"], ["event_id"])
    out = rounded(out, 4, "throttle_per_rpm", "speed_rolling_std", "delta_throttle", "engine_activity", "speed_rpm_index")
    return rounded(out, 3, "RPM_per_speed")


@query("k5_cluster_styles")
def k5(spark, sf):
    _, scores = labelling.cluster_styles(
        feature_rows(spark, sf), ["RPM", "THROTTLE_POS", "SPEED", "ENGINE_LOAD"], "ts", ["user_id"], ["event_id"])
    return scores


@query("k6_impute_fleet", gaps_sql())
def k6(spark, sf):
    f = with_gaps(spark, sf).withColumn("FUEL_PRESSURE", F.lit(54.0))
    return gaps_filled(f, fleet_plan.impute_fleet(f, ["ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_PER_RPM", "MAF"]))


STRESS = [
    ("ENGINE_LOAD", 0.25, False), ("COOLANT_TEMP", 0.20, False), ("AIR", 0.15, False), ("SHORT_FUEL_TRIM_1", 0.10, True),
    ("TIMING_ADVANCE", 0.10, True), ("O2", 0.20, True),
]


def stress_sql(parts):
    quantiles = ", ".join(
        f"quantile_cont({c}, 0.9) AS h{i}" + (f", quantile_cont({c}, 0.1) AS l{i}" if two else "")
        for i, (c, _, two) in enumerate(parts))
    def one(i, c, two):
        low = f"WHEN {c} < l{i} THEN greatest(least((l{i} - {c}) / l{i}, 1), 0) " if two else ""
        return f"(CASE {low}WHEN {c} > h{i} THEN greatest(least(({c} - h{i}) / (1 - h{i}), 1), 0) ELSE 0 END)"
    total = " + ".join(f"{w}::DOUBLE * {one(i, c, two)}" for i, (c, w, two) in enumerate(parts))
    return f"""{FLEET}, p AS (SELECT quantile_cont(AIRFLOW_PER_RPM, 0.99) AS p FROM fleet),
c AS (SELECT *, least(AIRFLOW_PER_RPM, p) AS capped, (O2_B1S2 + O2_B2S2) / 2 AS O2 FROM fleet, p),
n AS (SELECT *, (capped - min(capped) OVER ()) / (max(capped) OVER () - min(capped) OVER ()) AS AIR FROM c),
q AS (SELECT {quantiles} FROM n),
idx AS (SELECT n.*, {total} AS health FROM n, q)"""


NEED = """SELECT l_orderkey, l_linenumber, l_partkey, round(health, 6) AS "HealthIndex",
  round(least(greatest(health * 100, 0), 100), 1) AS need FROM idx"""


@query("k7_rule_maintenance_need", f"WITH {stress_sql(STRESS)} {NEED}")
def k7(spark, sf):
    out = fleet_plan.rule_maintenance_need(fleet(spark, sf))
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "HealthIndex",
                              F.round(F.col("HealthIndex") * 100, 1).alias("need")), 6, "HealthIndex")


@query("k7_rule_maintenance_need_maf", f"""WITH {stress_sql([*STRESS[:5], ("O2", 0.05, True), ("MAF", 0.15, False)])} {NEED}""")
def k7_maf(spark, sf):
    out = fleet_plan.rule_maintenance_need(fleet(spark, sf), with_maf=True)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "HealthIndex",
                              F.round(F.col("HealthIndex") * 100, 1).alias("need")), 6, "HealthIndex")


@query("k8_anomaly_maintenance_need", """
SELECT l_orderkey, l_linenumber, count(*) AS rows, true AS in_range FROM lineitem GROUP BY 1, 2""")
def k8(spark, sf):
    """Every row of the fleet set has a score from 0 to 100."""
    out = fleet_plan.anomaly_maintenance_need(fleet_plan.prepare_scores(fleet(spark, sf)), LINE_KEY, parts=spark.sparkContext.defaultParallelism)
    return out.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("MaintenanceNeed_IF").between(0, 100)).alias("in_range"))


@query("k9_train_maintenance_model")
def k9(spark, sf):
    scored = fleet_plan.rule_maintenance_need(fleet(spark, sf))
    features = ["ENGINE_LOAD", "COOLANT_TEMP", "SHORT_FUEL_TRIM_1", "TIMING_ADVANCE", "O2_COMBO"]
    return fleet_plan.train_maintenance_model(scored, features, LINE_KEY, "MaintenanceNeed").metrics


@query("k10_analyse_driving", f"""
WITH {EVENTS}, {DRIVE_LOG}, {STYLES} SELECT style AS driving_style, count(*) AS count,
  round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM styled), 6) AS percentage FROM styled GROUP BY style""")
def k10(spark, sf):
    """Whole event log: gaps, fills, rates, stateful style, share of each style."""
    out = driving.analyse_driving(drive_log(spark, sf), "ts", ["user_id"], ["event_id"], LIMITS)
    return rounded(driving.style_summary(out).withColumnRenamed("driving_style_analyzed", "driving_style"))


@query("k11_clean_drive_files", f"""
WITH {EVENTS}, f AS (SELECT event_id, strftime(ts, '%H:%M:%S.%f') AS clock,
  last_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS temp, k AS speed, 100 * k AS rpm FROM ev)
SELECT event_id, clock AS "Time", temp AS "Engine Coolant Temperature °C", speed AS "Vehicle Speed Sensor km/h", rpm AS "Engine RPM RPM"
FROM f WHERE temp BETWEEN -40 AND 130 AND speed BETWEEN 0 AND 250 AND rpm BETWEEN 0 AND 8000""")
def k11(spark, sf):
    e = events(spark, sf).select(
        "event_id", F.date_format("ts", "HH:mm:ss.SSSSSS").alias("Time"),
        F.col("x").alias("Engine Coolant Temperature [°C]"), F.col("k").alias(" Vehicle Speed Sensor [km/h]"),
        (100 * F.col("k")).alias("Engine RPM [RPM]"))
    out = cleaning.clean_drive_files(e, "Time", tie=["event_id"])
    return out.withColumn("Time", F.date_format("Time", "HH:mm:ss.SSSSSS"))


def service_table(spark, sf):
    """Orders as vehicles: categories, two dates, and a label."""
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey", F.col("o_totalprice").alias("Odometer"),
        F.when(F.col("o_orderstatus") == "F", "Truck").when(F.col("o_orderstatus") == "O", "Van").otherwise("Bus").alias("Vehicle_Model"),
        F.substring("o_orderpriority", 1, 1).alias("Service_History"),
        F.col("o_orderdate").alias("Last_Service_Date"), F.date_add("o_orderdate", 730).alias("Warranty_Expiry_Date"),
        (F.col("o_totalprice") > 250_000).cast("int").alias("Need_Maintenance"))


@query("k12_maintenance_features", """
SELECT o_orderkey, o_totalprice AS "Odometer", CAST(o_totalprice > 250000 AS INTEGER) AS "Need_Maintenance",
  CAST(datediff('day', o_orderdate, TIMESTAMP '2003-01-01') AS BIGINT) AS "Days_Since_Last_Service",
  CAST(datediff('day', TIMESTAMP '2003-01-01', o_orderdate) + 730 AS BIGINT) AS "Days_Until_Warranty_Expiry",
  CAST(o_orderstatus = 'O' AS INTEGER) AS "Vehicle_Model_1", CAST(o_orderstatus NOT IN ('F', 'O') AS INTEGER) AS "Vehicle_Model_2",
  CAST(left(o_orderpriority, 1) = '2' AS INTEGER) AS "Service_History_2", CAST(left(o_orderpriority, 1) = '3' AS INTEGER) AS "Service_History_3",
  CAST(left(o_orderpriority, 1) = '4' AS INTEGER) AS "Service_History_4", CAST(left(o_orderpriority, 1) = '5' AS INTEGER) AS "Service_History_5"
FROM orders""")
def k12(spark, sf):
    return training.maintenance_features(service_table(spark, sf), datetime(2003, 1, 1))


@query("k12_feature_report")
def k12_report(spark, sf):
    t = training.maintenance_features(service_table(spark, sf), datetime(2003, 1, 1))
    features = [c for c in t.columns if c not in ("o_orderkey", "Need_Maintenance")]
    return training.feature_report(t, features, "Need_Maintenance")


@query("k12_classifier_comparison")
def k12_models(spark, sf):
    t = training.maintenance_features(service_table(spark, sf), datetime(2003, 1, 1))
    features = [c for c in t.columns if c not in ("o_orderkey", "Need_Maintenance", "Odometer")]
    return training.classifier_comparison(t, features, "Need_Maintenance", ["o_orderkey"])


def truck_files(spark, sf):
    """Line items as readouts, orders as specifications, customers as outcomes."""
    readouts = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("vehicle_id")),
        F.col("l_orderkey") == F.col("o_orderkey")).select(
        "vehicle_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("r1"), "l_returnflag",
        F.when(F.col("l_linenumber") == 3, F.col("l_tax")).alias("thin"))
    specs = table(spark, sf, "customer").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_mktsegment").alias("Spec_0"))
    tte = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("vehicle_id"), F.col("c_acctbal").alias("tte"), (F.col("c_acctbal") < 0).cast("int").alias("in_study_repair"))
    return readouts, specs, tte


@query("k13_truck_table", """
WITH j AS (SELECT o_custkey AS vehicle_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_linenumber <> 3 THEN l_quantity END AS r1, l_returnflag, c_mktsegment, c_acctbal
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT vehicle_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  round(coalesce(r1, (SELECT avg(r1) FROM j)), 6) AS r1,
  CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS l_returnflag,
  CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS "Spec_0",
  c_acctbal AS tte, CAST(c_acctbal < 0 AS INTEGER) AS in_study_repair FROM j""")
def k13(spark, sf):
    readouts, specs, tte = truck_files(spark, sf)
    # the sparse column has far more gaps than the other one with gaps
    limit = readouts.count() // 2
    return rounded(training.truck_table(readouts, specs, tte, most_missing=limit), 6, "r1")


@query("k13_truck_component")
def k13_model(spark, sf):
    readouts, specs, tte = truck_files(spark, sf)
    t = training.truck_table(readouts, specs, tte, most_missing=readouts.count() // 2)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    importance, correlations = training.truck_component(t, key)
    return importance.join(correlations, "column")


@query("k14_score_quantiles", f"""
WITH {stress_sql(STRESS)}, shares AS (SELECT unnest([0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0])::DOUBLE AS quantile)
SELECT quantile, round(CASE {" ".join(f"WHEN quantile = {v}::DOUBLE THEN (SELECT quantile_cont(health, {v}) FROM idx)" for v in (0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0))} END, 5) AS rule,
  round(CASE {" ".join(f"WHEN quantile = {v}::DOUBLE THEN (SELECT quantile_cont(AIR, {v}) FROM idx)" for v in (0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0))} END, 5) AS airflow FROM shares""")
def k14(spark, sf):
    scored = fleet_plan.rule_maintenance_need(fleet(spark, sf))
    _, quantiles = fleet_plan.score_comparison(scored, {"rule": "HealthIndex", "airflow": "AIRFLOW_CAPPED_NORM"})
    return rounded(quantiles, 5)


@query("k14_score_histograms", f"""
WITH {stress_sql(STRESS)}, b AS (SELECT min(health) AS lo, max(health) AS hi FROM idx),
h AS (SELECT CAST(least(floor((health - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM idx, b GROUP BY 1)
SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS i) LEFT JOIN h ON bin = i""")
def k14_histograms(spark, sf):
    scored = fleet_plan.rule_maintenance_need(fleet(spark, sf))
    bars, _ = fleet_plan.score_comparison(scored, {"rule": "HealthIndex"}, 20)
    return bars.select("bin", "n")
