"""G2-G19."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from bindings.base import EVENTS, FLEET, events, fleet, query, rounded, table
from torqueline.operators import profile

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lines(spark, sf, *more):
    return table(spark, sf, "lineitem").select(*LINE, *more)


def per_column(cols, body, frm):
    """UNION ALL of one SELECT per column; ``{c}`` in ``body`` is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {body.format(c=c)} FROM {frm}" for c in cols)


@query("g2_value_counts_pct", f"""
WITH {EVENTS} SELECT label, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM ev), 6) AS percentage
FROM ev GROUP BY label""")
def g2(spark, sf):
    return rounded(profile.value_counts_pct(events(spark, sf), "label"))


@query("g3_conditional_proportion", """
SELECT count(*) FILTER (event_type = 'view') AS matching, count(*) AS total,
       round(count(*) FILTER (event_type = 'view') / count(*)::DOUBLE, 6) AS proportion FROM events""")
def g3(spark, sf):
    return rounded(profile.conditional_proportion(table(spark, sf, "events"), "event_type", "view"))


DESCRIBE = """count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25,
 round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75,
 round(CAST(max({c}) AS DOUBLE), 4) AS max"""


@query("g4_describe_numeric", per_column(LINE, DESCRIBE, "lineitem"))
def g4(spark, sf):
    return rounded(profile.describe_numeric(lines(spark, sf)), 4)


TEXT = """count({c}) AS count, count(DISTINCT {c}) AS "unique",
 (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1)) AS top,
 (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) AS freq"""


@query("g5_describe_all", f"""
SELECT "column", count, "unique", top, freq, mean, std, min, q25, q50, q75, max FROM (
 SELECT *, NULL::BIGINT AS "unique", NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM ({per_column(LINE, DESCRIBE, "lineitem")})
 UNION ALL BY NAME ({per_column(["l_returnflag", "l_linestatus"], TEXT, "lineitem")}))""")
def g5(spark, sf):
    return rounded(profile.describe_all(lines(spark, sf, "l_returnflag", "l_linestatus")), 4)


MISSING = "count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS share"


@query("g6_missing_profile", f"""
WITH {EVENTS} SELECT * FROM ({per_column(["event_id", "user_id", "x", "label"], MISSING, "ev")}) WHERE missing > 0""")
def g6(spark, sf):
    return rounded(profile.missing_profile(events(spark, sf).select("event_id", "user_id", "x", "label"), 10))


@query("g7_dataset_profile", """
SELECT event_type, count(*) AS rows, CAST(5 AS BIGINT) AS columns FROM events GROUP BY event_type""")
def g7(spark, sf):
    return profile.dataset_profile(table(spark, sf, "events"), "event_type")


@query("g8_median_per_column", per_column(LINE, "round(median({c}), 4) AS median", "lineitem"))
def g8(spark, sf):
    return rounded(profile.median_per_column(lines(spark, sf), LINE), 4)


@query("g9_mean_per_column", per_column(LINE, "round(avg({c}), 4) AS mean", "lineitem"))
def g9(spark, sf):
    return rounded(profile.mean_per_column(lines(spark, sf)), 4)


@query("g10_quantile", per_column(LINE, "round(quantile_cont({c}, 0.99), 4) AS value", "lineitem"))
def g10(spark, sf):
    return rounded(profile.quantile_per_column(lines(spark, sf), LINE, 0.99), 4)


ODD = """o AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'Infinity'::DOUBLE
  WHEN event_id % 11 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM events)"""


@query("g10_quantile_odd_values", f"WITH {ODD} " + " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(v, {q}), 4) AS v FROM o" for q in (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)))
def g10_odd(spark, sf):
    """NaN counts as missing; infinities are the ends of the order."""
    n = F.col("event_id")
    v = F.when(n % 7 == 0, F.lit(float("nan"))).when(n % 5 == 0, F.lit(float("inf"))).when(n % 11 == 0, F.lit(float("-inf")))
    e = table(spark, sf, "events").select(v.otherwise(F.col("value")).alias("v"))
    return rounded(profile.quantile_table(e, {"v": "v"}, (0.0, 0.25, 0.5, 0.75, 0.95, 1.0)), 4)


@query("g11_quantile_table", " UNION ALL ".join(
    f"SELECT {q}::DOUBLE AS quantile, round(quantile_cont(l_extendedprice, {q}), 4) AS price, "
    f"round(quantile_cont(l_quantity, {q}), 4) AS quantity FROM lineitem" for q in profile.TABLE_QUANTILES))
def g11(spark, sf):
    return rounded(profile.quantile_table(lines(spark, sf), {"price": "l_extendedprice", "quantity": "l_quantity"}), 4)


@query("g12_resample_mean", """
WITH h AS (SELECT date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY 1),
u AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h)
SELECT ts, round(h.value, 6) AS value FROM u LEFT JOIN h USING (ts)""")
def g12(spark, sf):
    return rounded(profile.resample_mean(table(spark, sf, "events"), "ts", ["value"]))


def corr_rows(cols, frm):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {frm}" for a, b in product(cols, cols))


@query("g13_correlation_matrix", corr_rows(LINE, "lineitem"))
def g13(spark, sf):
    return rounded(profile.correlation(lines(spark, sf)))


SENSORS = ["ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_PER_RPM", "MAF"]


@query("g14_strong_pairs", f"""
WITH {FLEET}, c AS ({corr_rows(SENSORS, "fleet")}) SELECT x, y, r FROM c WHERE abs(r) > 0.1 AND x < y""")
def g14(spark, sf):
    return rounded(profile.strong_pairs(profile.correlation(fleet(spark, sf), SENSORS), 0.1))


@query("g15_point_biserial", per_column(
    LINE, "round(corr({c}, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 6) AS r", "lineitem"))
def g15(spark, sf):
    return rounded(profile.point_biserial(lines(spark, sf, "l_returnflag"), LINE, F.col("l_returnflag") == "R"))


CHI2 = """(SELECT round(sum((o - e) * (o - e) / e), 4) FROM (
   SELECT sum(z) AS o, count(*) * (SELECT sum(z) FROM (SELECT ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS z FROM lineitem))
      / (SELECT count(*) FROM lineitem) AS e
   FROM (SELECT l_returnflag, ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS z FROM lineitem)
   GROUP BY l_returnflag)) AS chi2"""


@query("g16_chi2_score", per_column(LINE, CHI2, "(SELECT 1)"))
def g16(spark, sf):
    return rounded(profile.chi2_scores(lines(spark, sf, "l_returnflag"), LINE, "l_returnflag"), 4)


@query("g17_histogram", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
SELECT i AS bin, round(lo + i * ((hi - lo) / 50), 4) AS lo, round(lo + (i + 1) * ((hi - lo) / 50), 4) AS hi,
  coalesce(n, 0) AS n FROM b, (SELECT unnest(range(50)) AS i) LEFT JOIN h ON bin = i""")
def g17(spark, sf):
    return rounded(profile.histogram(lines(spark, sf), "l_extendedprice", 50), 4)


@query("g18_kde_curve", """
WITH s AS (SELECT count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem),
v AS (SELECT l_quantity AS v, count(*) AS m FROM lineitem GROUP BY 1),
g AS (SELECT unnest(range(200)) AS i)
SELECT round(lo + i * ((hi - lo) / 199), 6) AS x,
  round(sum(m * exp(-pow((lo + i * ((hi - lo) / 199) - v) / h, 2) / 2)) / (n * h * sqrt(2 * pi())), 8) AS density
FROM s, g, v GROUP BY i, lo, hi, n, h""")
def g18(spark, sf):
    out = profile.kde_curve(lines(spark, sf), "l_quantity")
    return out.select(F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))



@query("g19_box_stats", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(q1, 4) AS q25, round(q2, 4) AS q50, round(q3, 4) AS q75,
  round(min({c}) FILTER ({c} BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_lo,
  round(max({c}) FILTER ({c} BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)), 4) AS whisker_hi,
  count(*) FILTER ({c} NOT BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)) AS outliers
FROM fleet, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM fleet)
GROUP BY q1, q2, q3""" for c in ["ENGINE_LOAD", "AIRFLOW_PER_RPM"]).replace(
    "\nSELECT 'ENGINE_LOAD'", f"WITH {FLEET}\nSELECT 'ENGINE_LOAD'", 1))
def g19(spark, sf):
    return rounded(profile.box_stats(fleet(spark, sf), ["ENGINE_LOAD", "AIRFLOW_PER_RPM"]), 4)
