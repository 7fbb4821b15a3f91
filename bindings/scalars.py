"""F1-F27."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from bindings.base import EVENTS, FLEET, events, fleet, query, rounded, table
from torqueline import functions as fn
from torqueline.operators import encode, scaling, sequence
from torqueline.operators.timeline import timeline

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("f1_normalize_timestamp_key", """
SELECT event_id, translate(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ':. /', '--T-') AS session_key FROM events""")
def f1(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", fn.normalize_timestamp_key(F.date_format("ts", TS_TEXT)).alias("session_key"))


@query("f2_parse_timestamp", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE ts END AS parsed FROM events""")
def f2(spark, sf):
    e = table(spark, sf, "events")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", TS_TEXT))
        .when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 4 == 2, fn.normalize_timestamp_key(F.date_format("ts", TS_TEXT)))
        .otherwise("no time")
    )
    return e.select("event_id", fn.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))


@query("f3_to_numeric", """
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS number FROM events""")
def f3(spark, sf):
    m = F.col("event_id") % 5
    text = F.when(m == 0, "abc").when(m == 1, "NaN").when(m == 2, "12.5d").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", fn.to_number(text).alias("number"))


@query("f4_sentinel_to_null", f"""
WITH {EVENTS} SELECT event_id, CASE WHEN s IN (-22, -40, 255) THEN NULL ELSE s END AS reading FROM ev""")
def f4(spark, sf):
    return events(spark, sf).select("event_id", fn.sentinel_to_null("s").alias("reading"))


@query("f5_out_of_range_to_null", f"""
WITH {EVENTS} SELECT event_id, CASE WHEN 40 * k BETWEEN 100 AND 6000 THEN CAST(40 * k AS DOUBLE) END AS rpm FROM ev""")
def f5(spark, sf):
    return events(spark, sf).select("event_id", fn.outside_to_null(40 * F.col("k"), 100, 6000).alias("rpm"))


@query("f6_fill_median", f"""
WITH {EVENTS} SELECT event_id, round(coalesce(x, (SELECT median(x) FROM ev)), 6) AS x FROM ev""")
def f6_median(spark, sf):
    return rounded(scaling.fill(events(spark, sf).select("event_id", "x"), ["x"], "median"))


@query("f6_fill_mean", f"""
WITH {EVENTS} SELECT event_id, round(coalesce(x, (SELECT avg(x) FROM ev)), 6) AS x FROM ev""")
def f6_mean(spark, sf):
    return rounded(scaling.fill(events(spark, sf).select("event_id", "x"), ["x"], "mean"))


@query("f6_fill_constant", f"""
WITH {EVENTS} SELECT event_id, coalesce(x, CAST(0 AS DOUBLE)) AS x FROM ev""")
def f6_constant(spark, sf):
    return scaling.fill(events(spark, sf).select("event_id", "x"), ["x"], 0.0)


@query("f7_min_max_scale", f"""
WITH {EVENTS}, b AS (SELECT min(x) AS lo, max(x) AS hi, min(k) AS klo, max(k) AS khi FROM ev)
SELECT event_id, round((x - lo) / (hi - lo), 6) AS x, round((k - klo) / (khi - klo), 6) AS k,
       CAST(0 AS DOUBLE) AS fixed FROM ev, b""")
def f7(spark, sf):
    e = events(spark, sf).select("event_id", "x", "k", F.lit(7.0).alias("fixed"))
    return rounded(scaling.min_max(e, ["x", "k", "fixed"]))


@query("f8_standard_scale", f"""
WITH {EVENTS}, b AS (SELECT avg(x) AS m, stddev_pop(x) AS d, avg(k) AS km, stddev_pop(k) AS kd FROM ev)
SELECT event_id, round((x - m) / d, 6) AS x, round((k - km) / kd, 6) AS k, CAST(0 AS DOUBLE) AS fixed FROM ev, b""")
def f8(spark, sf):
    e = events(spark, sf).select("event_id", "x", "k", F.lit(7.0).alias("fixed"))
    return rounded(scaling.standardise(e, ["x", "k", "fixed"]))


@query("f9_row_mean", f"""
WITH {EVENTS} SELECT event_id, round(CASE WHEN x IS NULL THEN k ELSE (x + k) / 2 END, 6) AS mean FROM ev""")
def f9(spark, sf):
    return rounded(events(spark, sf).select("event_id", fn.row_mean("x", "k").alias("mean")))


@query("f10_safe_ratio", f"""
WITH {EVENTS} SELECT event_id, round(value / nullif(k, 0), 9) AS ratio FROM ev""")
def f10(spark, sf):
    return rounded(events(spark, sf).select("event_id", fn.safe_ratio("value", "k").alias("ratio")), 9)


@query("f11_eps_ratio", f"""
WITH {EVENTS} SELECT event_id, round(value / (k + 0.001::DOUBLE), 4) AS ratio FROM ev""")
def f11(spark, sf):
    return rounded(events(spark, sf).select("event_id", fn.eps_ratio("value", "k").alias("ratio")), 4)


@query("f12_pair_mean", f"""
WITH {EVENTS} SELECT event_id, round((x + k) / 2, 6) AS mean FROM ev""")
def f12(spark, sf):
    return rounded(events(spark, sf).select("event_id", fn.pair_mean("x", "k").alias("mean")))


@query("f13_unit_convert", """
SELECT event_id, round(value * (1 / 3.6::DOUBLE), 6) AS mps, round(value / 9.80665::DOUBLE, 6) AS g FROM events""")
def f13(spark, sf):
    return rounded(table(spark, sf, "events").select(
        "event_id", fn.kph_to_mps("value").alias("mps"), fn.mps2_to_g("value").alias("g")))


@query("f14_days_since", """
SELECT o_orderkey, CAST(datediff('day', o_orderdate, TIMESTAMP '2003-01-01') AS BIGINT) AS since,
       CAST(datediff('day', TIMESTAMP '2003-01-01', o_orderdate) AS BIGINT) AS until FROM orders""")
def f14(spark, sf):
    as_of = datetime(2003, 1, 1)
    return table(spark, sf, "orders").select(
        "o_orderkey", fn.days_since("o_orderdate", as_of).alias("since"), fn.days_until("o_orderdate", as_of).alias("until"))


@query("f15_clip", f"""
WITH {EVENTS} SELECT event_id, CASE WHEN x IS NOT NULL THEN least(greatest(x, 10), 100) END AS x FROM ev""")
def f15(spark, sf):
    return events(spark, sf).select("event_id", fn.clip("x", 10, 100).alias("x"))


@query("f16_cap_at_quantile", f"""
WITH {FLEET}, q AS (SELECT quantile_cont(AIRFLOW_PER_RPM, 0.99) AS p FROM fleet),
c AS (SELECT l_orderkey, l_linenumber, least(AIRFLOW_PER_RPM, p) AS capped FROM fleet, q),
b AS (SELECT min(capped) AS lo, max(capped) AS hi FROM c)
SELECT l_orderkey, l_linenumber, round(capped, 12) AS capped, round((capped - lo) / (hi - lo), 9) AS scaled FROM c, b""")
def f16(spark, sf):
    f = fleet(spark, sf).select("l_orderkey", "l_linenumber", "AIRFLOW_PER_RPM")
    out = scaling.cap_at_quantile(f, "AIRFLOW_PER_RPM", "capped", 0.99, scaled="scaled")
    return rounded(rounded(out.drop("AIRFLOW_PER_RPM"), 12, "capped"), 9, "scaled")


@query("f17_stress_upper", f"""
WITH {FLEET}, q AS (SELECT quantile_cont(ENGINE_LOAD, 0.9) AS t FROM fleet)
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN ENGINE_LOAD > t THEN least((ENGINE_LOAD - t) / (1 - t), 1) ELSE 0 END, 6) AS stress FROM fleet, q""")
def f17(spark, sf):
    f = fleet(spark, sf).select("l_orderkey", "l_linenumber", "ENGINE_LOAD")
    return rounded(scaling.add_stress(f, {"stress": "ENGINE_LOAD"}, {}).drop("ENGINE_LOAD"))


@query("f18_stress_two_sided", f"""
WITH {FLEET}, q AS (SELECT quantile_cont(O2_B1S2, 0.1) AS lo, quantile_cont(O2_B1S2, 0.9) AS hi FROM fleet)
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN O2_B1S2 < lo THEN least((lo - O2_B1S2) / lo, 1)
                  WHEN O2_B1S2 > hi THEN least((O2_B1S2 - hi) / (1 - hi), 1) ELSE 0 END, 6) AS stress FROM fleet, q""")
def f18(spark, sf):
    f = fleet(spark, sf).select("l_orderkey", "l_linenumber", "O2_B1S2")
    return rounded(scaling.add_stress(f, {}, {"stress": "O2_B1S2"}).drop("O2_B1S2"))


@query("f19_weighted_index", f"""
WITH {FLEET} SELECT l_orderkey, l_linenumber, round(0.25::DOUBLE * ENGINE_LOAD + 0.75::DOUBLE * MAF, 6) AS idx,
  least(greatest(round_even((0.25::DOUBLE * ENGINE_LOAD + 0.75::DOUBLE * MAF) * 100, 2), 0), 100) AS score FROM fleet""")
def f19(spark, sf):
    out = scaling.add_weighted_index(fleet(spark, sf), {"ENGINE_LOAD": 0.25, "MAF": 0.75}, "idx", "score")
    return rounded(out.select("l_orderkey", "l_linenumber", "idx", "score"), 6, "idx")


@query("f20_map_values", """
SELECT event_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 END AS rank FROM events""")
def f20(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", fn.map_values("event_type", {"view": 0, "click": 1, "purchase": 2}).alias("rank"))


@query("f21_canonical_label", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'Passive' WHEN 'click' THEN 'Moderate'
       ELSE event_type END AS style FROM events""")
def f21(spark, sf):
    spellings = {"error": None, "view": "Passive", "click": "Moderate"}
    return table(spark, sf, "events").select("event_id", fn.canonical_label("event_type", spellings).alias("style"))


@query("f22_label_encode", f"""
WITH {EVENTS}, d AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code
                     FROM (SELECT DISTINCT label FROM ev WHERE label IS NOT NULL))
SELECT event_id, CAST(coalesce(code, -1) AS INTEGER) AS code FROM ev LEFT JOIN d USING (label)""")
def f22(spark, sf):
    e = events(spark, sf).select("event_id", "label")
    return encode.label_encode(e, ["label"]).withColumnRenamed("label", "code")


@query("f23_one_hot_drop_first", f"""
WITH {EVENTS} SELECT event_id, CAST(coalesce(label = 'error', false) AS INTEGER) AS label_error,
  CAST(coalesce(label = 'purchase', false) AS INTEGER) AS label_purchase,
  CAST(coalesce(label = 'signup', false) AS INTEGER) AS label_signup,
  CAST(coalesce(label = 'view', false) AS INTEGER) AS label_view FROM ev""")
def f23(spark, sf):
    return encode.one_hot_drop_first(events(spark, sf).select("event_id", "label"), ["label"])


@query("f24_text_replace", """
SELECT p_partkey, regexp_replace(replace(trim('  ' || p_name || ' '), 'ring', 'washer'), '[ ]+', '_', 'g') AS name FROM part""")
def f24(spark, sf):
    padded = F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", fn.clean_text(padded, {"ring": "washer"}, "[ ]+", "_").alias("name"))


@query("f25_display_timestamp", """
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE
  printf('%02d:', (CAST(strftime(ts, '%H') AS INTEGER) + 22) % 24) || strftime(ts, '%M %d/%m/%Y') END AS shown FROM events""")
def f25(spark, sf):
    key = F.when(F.col("event_id") % 10 == 0, "unknown").otherwise(
        fn.normalize_timestamp_key(F.date_format("ts", TS_TEXT)))
    return table(spark, sf, "events").select("event_id", fn.display_timestamp(key).alias("shown"))


@query("f26_map_to_columns", f"""
WITH {EVENTS} SELECT event_id, k FROM ev""")
def f26(spark, sf):
    e = table(spark, sf, "events").select("event_id", encode.json_object("props").alias("data"))
    return encode.map_to_columns(e, "data")


@query("f27_inf_to_zero", f"""
WITH {EVENTS}, t AS (SELECT event_id, user_id, date_trunc('day', ts) AS day, ts, value FROM ev),
g AS (SELECT event_id, value - lag(value) OVER w AS d,
             (epoch_us(day) - epoch_us(lag(day) OVER w)) / 1e6::DOUBLE AS gap
      FROM t WINDOW w AS (PARTITION BY user_id ORDER BY day, event_id))
SELECT event_id, round(86400 * coalesce(d / nullif(gap, 0), 0), 6) AS per_day FROM g""")
def f27(spark, sf):
    """Days as times: many gaps are 0, so many plain quotients would be infinite."""
    e = events(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    tl = sequence.time_gap(timeline(e, "day", ["user_id"], ["event_id"]), "gap")
    out = sequence.rates_of_change(tl, {"rate": "value"}, "gap").frame
    return rounded(out.select("event_id", (86400 * F.col("rate")).alias("per_day")))
