"""P1-P21, G20, G21, O1-O4, U1-U2, J1-J5."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import EVENTS, events, query, table
from torqueline.operators import columns, joins, rows
from torqueline.operators.timeline import timeline
from torqueline.operators.sequence import row_index


def planted(spark, sf):
    """Events with constant, empty, repeated and sparse columns beside the real ones."""
    return events(spark, sf).select(
        "event_id", "ts", "value", "x", "s", "label",
        F.lit(5.0).alias("fixed"), F.lit(None).cast("double").alias("empty"),
        F.col("x").alias("x_again"), F.col("value").alias("value_again"),
        F.when(F.col("event_id") % 10 == 0, F.col("value")).alias("sparse"),
        F.when(F.col("event_id") % 5 == 0, F.col("k")).alias("edge"),
    )


PLANTED = f"""{EVENTS}, pl AS (
  SELECT event_id, ts, value, x, s, label, CAST(5 AS DOUBLE) AS fixed, CAST(NULL AS DOUBLE) AS empty,
         x AS x_again, value AS value_again, CASE WHEN event_id % 10 = 0 THEN value END AS sparse,
         CASE WHEN event_id % 5 = 0 THEN k END AS edge FROM ev)"""

GAPS = " + ".join(f"({c} IS NULL)::INT" for c in ["x", "x_again", "label", "sparse", "edge", "empty"])


@query("p1_select_existing", "SELECT ts, event_id FROM events")
def p1(spark, sf):
    return columns.select_existing(table(spark, sf, "events"), ["ts", "SPEED", "event_id"])


@query("p2_drop_existing", "SELECT event_id, ts, user_id, event_type FROM events")
def p2(spark, sf):
    return columns.drop_existing(table(spark, sf, "events"), ["value", "props", "FUEL_PRESSURE"])


@query("p3_rename_map", "SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders")
def p3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return columns.rename_map(o, {"o_orderkey": "order_id", "o_totalprice": "total"})


@query("p4_normalise_column_names", """
SELECT event_id, value AS "Coolant °C", user_id AS "Engine RPM RPM" FROM events""")
def p4(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.col("value").alias(" Coolant [Â°C]"), F.col("user_id").alias("Engine RPM [RPM] "))
    return columns.normalise_column_names(e)


@query("p5_select_numeric", "SELECT event_id, user_id, value FROM events")
def p5_numeric(spark, sf):
    e = table(spark, sf, "events")
    return e.select(columns.numeric_columns(e))


@query("p5_select_text", "SELECT event_type, props FROM events")
def p5_text(spark, sf):
    e = table(spark, sf, "events")
    return e.select(columns.text_columns(e))


@query("p6_ensure_columns", "SELECT event_id, value, CAST(NULL AS DOUBLE) AS RPM FROM events")
def p6(spark, sf):
    return columns.ensure_columns(table(spark, sf, "events").select("event_id", "value"), ["value", "RPM"])


@query("p7_tag_column", "SELECT event_id, 'drive' AS source_type FROM events")
def p7(spark, sf):
    return columns.tag_column(table(spark, sf, "events").select("event_id"), "source_type", "drive")


@query("p8_range_filter", f"""
WITH {EVENTS} SELECT event_id, x, k FROM ev WHERE x BETWEEN 10 AND 100 AND k BETWEEN 0 AND 50""")
def p8(spark, sf):
    return rows.range_filter(events(spark, sf).select("event_id", "x", "k"), {"x": (10, 100), "k": (0, 50)})


@query("p9_drop_rows_missing_over_ratio", f"""
WITH {EVENTS} SELECT event_id, label, x, a, b FROM (
  SELECT event_id, ts, label, x, CASE WHEN event_id % 2 = 0 THEN k END AS a, CASE WHEN event_id % 3 = 0 THEN k END AS b FROM ev)
WHERE (label IS NULL)::INT + (x IS NULL)::INT + (a IS NULL)::INT + (b IS NULL)::INT <= 1""")
def p9(spark, sf):
    """Share 0.2 of the five columns beside the timestamp: one gap is allowed."""
    e = events(spark, sf).select(
        "event_id", "ts", "label", "x", F.when(F.col("event_id") % 2 == 0, F.col("k")).alias("a"),
        F.when(F.col("event_id") % 3 == 0, F.col("k")).alias("b"))
    return rows.drop_rows_missing_over_ratio(e, 0.2, "ts").drop("ts")


@query("p10_drop_rows_missing_over_n", f"""
WITH {PLANTED} SELECT event_id FROM pl WHERE {GAPS} <= 4""")
def p10(spark, sf):
    return rows.drop_rows_missing_over_n(planted(spark, sf), 4).select("event_id")


@query("p11_require_n_present", f"""
WITH {PLANTED} SELECT ts, x, sparse, edge FROM pl
WHERE (x IS NOT NULL)::INT + (sparse IS NOT NULL)::INT + (edge IS NOT NULL)::INT > 1""")
def p11(spark, sf):
    return rows.require_n_present(planted(spark, sf).select("ts", "x", "sparse", "edge"), 2, "ts")


@query("p12_require_any_present", f"""
WITH {PLANTED} SELECT event_id, sparse, edge FROM pl WHERE coalesce(sparse, edge) IS NOT NULL""")
def p12(spark, sf):
    return rows.require_any_present(planted(spark, sf).select("event_id", "sparse", "edge"), ["sparse", "edge", "MAF"])


@query("p13_dropna", f"WITH {EVENTS} SELECT event_id, x, label FROM ev WHERE x IS NOT NULL AND label IS NOT NULL")
def p13(spark, sf):
    return rows.dropna(events(spark, sf).select("event_id", "x", "label"), ["x", "label"])


@query("p14_mask_filter", f"WITH {EVENTS} SELECT event_id FROM ev WHERE x IS NULL OR x <= 100")
def p14(spark, sf):
    return rows.mask_filter(events(spark, sf).withColumn("far", F.col("x") > 100), "far").select("event_id")


@query("p15_conditional_update", """
SELECT event_id, CASE WHEN value < 20 THEN 'idle' ELSE event_type END AS event_type FROM events""")
def p15(spark, sf):
    e = table(spark, sf, "events")
    return rows.conditional_update(e, "event_type", F.col("value") < 20, "idle").select("event_id", "event_type")


@query("p16_sample_rows", """
SELECT event_id, user_id, value FROM events ORDER BY ('0x' || substr(md5('42|' || event_id), 1, 15))::BIGINT, event_id LIMIT 1000""")
def p16(spark, sf):
    """A thousand rows of the table, those with the smallest hashes of their key."""
    return rows.sample_rows(table(spark, sf, "events"), 1000, ["event_id"], draw=rows.row_hash(["event_id"], 42)).select("event_id", "user_id", "value")


@query("p17_drop_constant_columns", f"WITH {PLANTED} SELECT * EXCLUDE (empty) FROM pl")
def p17(spark, sf):
    """The constant column is protected, the empty one is not."""
    return columns.drop_constant_columns(planted(spark, sf), ["ts", "label", "fixed"])


@query("p18_drop_identical_columns", f"WITH {PLANTED} SELECT * EXCLUDE (x_again, value_again) FROM pl")
def p18(spark, sf):
    return columns.drop_identical_columns(planted(spark, sf))


@query("p19_drop_sparse_columns", f"WITH {PLANTED} SELECT * EXCLUDE (sparse, empty) FROM pl")
def p19(spark, sf):
    """Gaps in 90 % of rows go, gaps in 80 % stay."""
    return columns.drop_sparse_columns(planted(spark, sf), 0.8)


@query("p20_drop_columns_null_count", f"WITH {PLANTED} SELECT * EXCLUDE (sparse, empty, edge) FROM pl")
def p20(spark, sf):
    p = planted(spark, sf)
    return columns.drop_columns_null_count(p, p.count() // 2)


@query("p21_drop_all_null_columns", f"WITH {PLANTED} SELECT * EXCLUDE (empty) FROM pl")
def p21(spark, sf):
    return columns.drop_all_null_columns(planted(spark, sf), ["x", "sparse", "empty"])


@query("g20_distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def g20(spark, sf):
    return rows.distinct_rows(table(spark, sf, "events").select("user_id", "event_type"))


@query("g21_dedup_by_key_first", """
SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
WHERE rn = 1""")
def g21(spark, sf):
    return rows.dedup_by_key_first(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"]).select(
        "user_id", "event_id", "value")


@query("o1_sort_by_time", "SELECT event_id, ts, value FROM events ORDER BY ts, event_id")
def o1(spark, sf):
    return rows.sort_by_time(table(spark, sf, "events").select("event_id", "ts", "value"), "ts", ["event_id"])


@query("o2_top_k_desc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def o2(spark, sf):
    return rows.top_k_desc(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, ["o_orderkey"])


@query("o3_n_largest", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def o3(spark, sf):
    return rows.n_largest(table(spark, sf, "events").select("event_id", "value"), "value", ["event_id"])


@query("o4_head", "SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 20")
def o4(spark, sf):
    return rows.head(table(spark, sf, "events"), 20, ["ts", "event_id"], ["event_id", "value"])


@query("u1_union_all", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def u1(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return joins.union_all(c, s)


@query("u2_schema_intersection", """
SELECT c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""")
def u2(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.col("s_acctbal").alias("balance"))
    shared = columns.schema_intersection([c, s])
    return joins.union_all(c.select(*shared), s.select(*shared))


@query("j1_inner_equi_join", """
SELECT o_custkey AS vehicle_id, o_orderkey, o_totalprice AS price_x, c_acctbal AS price_y, c_mktsegment, n
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = o_custkey""")
def j1(spark, sf):
    """Orders as readouts, customers as specifications, event counts as a third file."""
    readouts = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("vehicle_id"), "o_orderkey", F.col("o_totalprice").alias("price"))
    specs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("vehicle_id"), F.col("c_acctbal").alias("price"), "c_mktsegment")
    counts = table(spark, sf, "events").groupBy(F.col("user_id").alias("vehicle_id")).agg(F.count("*").alias("n"))
    return joins.inner_equi_join(joins.inner_equi_join(readouts, specs, "vehicle_id"), counts, "vehicle_id")


@query("j2_left_equi_join", """
WITH a AS (SELECT * FROM (SELECT o_orderdate AS day, o_orderkey, o_totalprice,
  row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1),
b AS (SELECT * FROM (SELECT l_shipdate AS day, l_returnflag,
  row_number() OVER (PARTITION BY l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn = 1)
SELECT a.day, a.o_orderkey, a.o_totalprice, b.l_returnflag FROM a LEFT JOIN b USING (day)""")
def j2(spark, sf):
    """First order of each day with the first return flag shipped on that day."""
    orders = table(spark, sf, "orders").select(F.col("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    firsts = rows.dedup_by_key_first(
        table(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "day"), ["day"],
        ["l_orderkey", "l_linenumber", "l_partkey"])
    return joins.left_equi_join(
        orders.withColumnRenamed("o_orderkey", "at"), firsts.select("day", F.col("l_orderkey").alias("at"), "l_returnflag"),
        "day", ["at"]).withColumnRenamed("at", "o_orderkey")


@query("j3_semi_join_flag", """
SELECT event_id, user_id, user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) > 70) AS busy FROM events""")
def j3(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id")
    busy = e.groupBy("user_id").count().filter("count > 70")
    return joins.semi_join_flag(e, busy, ["user_id"], "busy")


@query("j4_row_aligned_lookup", f"""
WITH {EVENTS} SELECT event_id, x, label FROM ev WHERE x IS NOT NULL""")
def j4(spark, sf):
    e = events(spark, sf)
    return joins.row_aligned_lookup(e.select("event_id", "x").dropna(), e, ["event_id"], "label")


@query("j5_column_concat", """
WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal FROM customer),
b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_acctbal FROM supplier)
SELECT coalesce(a.i, b.i) AS i, c_acctbal, s_acctbal FROM a FULL JOIN b ON a.i = b.i""")
def j5(spark, sf):
    a = row_index(timeline(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey"), "i").frame
    b = row_index(timeline(table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_suppkey"), "i").frame
    return joins.column_concat(a.drop("c_custkey"), b.drop("s_suppkey"), "i")
