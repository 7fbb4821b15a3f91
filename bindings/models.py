"""M1-M21.  Metrics of whole fitted models have no SQL twin; their first steps, and models small enough for SQL, do."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.base import FLEET, LINE_KEY, fleet, query, rounded, table
from torqueline.operators import ml, trees
from torqueline.operators.iforest import IsolationForest, isolation_forest_score
from torqueline.operators.impute import IterativeImputer
from torqueline.operators.rbf import rbf_outlier_flag
from torqueline.operators.scaling import min_max
from torqueline.session import settle

SENSORS = ["ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_PER_RPM", "SHORT_FUEL_TRIM_1", "TIMING_ADVANCE", "O2_B1S2"]


def labelled(spark, sf):
    """Fleet rows with a 0/1 label that follows from the sensors, but not on every row."""
    noisy = F.pmod(F.xxhash64(*LINE_KEY), F.lit(10)) == 0
    need = (F.col("ENGINE_LOAD") + F.col("COOLANT_TEMP") > 1.1) != noisy
    return fleet(spark, sf).withColumn("need", need.cast("int"))


KEYS = ", ".join(LINE_KEY)
WHOLE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
WHOLE_KEY_TEXT = " || '|' || ".join(f"{c}::VARCHAR" for c in WHOLE_KEY)


def tasks(spark) -> int:
    """Partitions for the few files of the test tables."""
    return spark.sparkContext.defaultParallelism


def target_rows(spark, sf):
    return fleet(spark, sf).withColumn(
        "target", 60 * F.col("ENGINE_LOAD") + 30 * F.col("COOLANT_TEMP") * F.col("O2_B1S2") + 10 * F.col("MAF"))


@query("m1_train_test_split", f"""
SELECT count(*) AS rows, count(DISTINCT ({KEYS})) AS keys, round(sum(l_extendedprice), 2) AS price, true AS near_a_fifth FROM lineitem""")
def m1(spark, sf):
    """Both parts together are the table, no row is in both, and a fifth is held out."""
    train, test = ml.train_test_split(fleet(spark, sf), LINE_KEY)
    both = train.withColumn("test", F.lit(0)).unionAll(test.withColumn("test", F.lit(1)))
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(F.struct(*LINE_KEY)).alias("keys"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        (F.abs(F.avg("test") - 0.2) < 0.02).alias("near_a_fifth"))


def split(spark, sf):
    return ml.train_test_split(labelled(spark, sf).select(*LINE_KEY, *SENSORS, "need"), LINE_KEY)


@query("m2_random_forest_classifier")
def m2(spark, sf):
    train, test = split(spark, sf)
    model = ml.random_forest_classifier(train, SENSORS, "need")
    return ml.evaluate_classifier(ml.predict(model, test), "need", "prediction")


@query("m3_boosted_tree_classifier")
def m3(spark, sf):
    train, test = split(spark, sf)
    model = ml.boosted_tree_classifier(train, SENSORS, "need")
    return ml.evaluate_classifier(ml.predict(model, test), "need", "prediction")


@query("m4_logistic_regression")
def m4(spark, sf):
    train, test = split(spark, sf)
    model = ml.logistic_regression(train, SENSORS, "need")
    return ml.evaluate_classifier(ml.predict(model, test), "need", "prediction")


def halves() -> str:
    """Newton steps for an intercept and one weight, penalty 1 on the weight."""
    p = "1 / (1 + exp(-(b0 + b1 * x)))"
    return f"""WITH RECURSIVE {FLEET}, t AS (SELECT ENGINE_LOAD AS x, CASE WHEN ENGINE_LOAD + COOLANT_TEMP > 1.1 THEN 1 ELSE 0 END AS y FROM fleet),
s AS (
  SELECT 0 AS k, 0::DOUBLE AS b0, 0::DOUBLE AS b1
  UNION ALL
  SELECT k + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT k, b0, b1, sum({p} - y) AS g0, sum(({p} - y) * x) + b1 AS g1, sum({p} * (1 - {p})) AS h00,
           sum({p} * (1 - {p}) * x) AS h01, sum({p} * (1 - {p}) * x * x) + 1 AS h11
    FROM s, t WHERE k < 14 GROUP BY k, b0, b1))
SELECT round(b0, 5) AS intercept, round(b1, 5) AS weight FROM s WHERE k = 14"""


@query("m4_logistic_one_feature", halves())
def m4_one(spark, sf):
    """Intercept and weight of the penalised fit."""
    f = fleet(spark, sf).select("ENGINE_LOAD", (F.col("ENGINE_LOAD") + F.col("COOLANT_TEMP") > 1.1).cast("int").alias("y"))
    model = ml.logistic_regression(f, ["ENGINE_LOAD"], "y")
    return f.limit(1).select(F.round(F.lit(model.intercept), 5).alias("intercept"), F.round(F.lit(model.weights[0]), 5).alias("weight"))


# ---- first levels of boosted trees and forests, replayed

_N_SENSORS = len(SENSORS)
CUTS = ", ".join(f"{i / 64}" for i in range(1, 64))


def best_sql(name: str, rows: str, penalty: float) -> str:
    """The best (feature, cut) over candidate rows (j, x, g, h); ties go to the first feature and the lowest cut."""
    return f"""{name}_s AS (SELECT j, cut, sum(CASE WHEN x <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN x <= cut THEN h ELSE 0 END) AS hl,
  sum(g) AS g, sum(h) AS h FROM {rows} JOIN q USING (j) GROUP BY j, cut),
{name} AS (SELECT j, cut, gl * gl / (hl + {penalty}) + (g - gl) ** 2 / (h - hl + {penalty}) - g * g / (h + {penalty}) AS gain
  FROM {name}_s WHERE hl >= 1 AND h - hl >= 1 ORDER BY gain DESC, j, cut LIMIT 1)"""


def two_levels(target: str, gradient: str, hessian: str) -> str:
    cols = ", ".join(SENSORS)
    return f"""
WITH {FLEET}, t AS (SELECT row_number() OVER () AS r, {cols}, ({target})::DOUBLE AS y FROM fleet), m AS (SELECT avg(y) AS mean FROM t),
q AS ({" UNION ALL ".join(f"SELECT {j} AS j, unnest(list_distinct(quantile_cont({c}, [{CUTS}]))) AS cut FROM t" for j, c in enumerate(SENSORS))}),
long AS (SELECT r, unnest(range({_N_SENSORS})) AS j, unnest([{cols}]) AS x, {gradient} AS g, {hessian} AS h FROM t, m),
{best_sql("top", "long", 1.0)},
low AS (SELECT * FROM long WHERE r IN (SELECT r FROM long JOIN top USING (j) WHERE x <= cut)),
high AS (SELECT * FROM long WHERE r NOT IN (SELECT r FROM long JOIN top USING (j) WHERE x <= cut)),
{best_sql("left_", "low", 1.0)}, {best_sql("right_", "high", 1.0)},
n AS (SELECT 0 AS node, * FROM top UNION ALL SELECT 1, * FROM left_ UNION ALL SELECT 2, * FROM right_)
SELECT node::BIGINT AS node, [{", ".join(f"'{c}'" for c in SENSORS)}][j + 1] AS feature, round(cut, 6) AS cut, round(gain / (SELECT count(*) FROM t), 5) AS gain FROM n"""


def first_levels(f, model: trees.TreeEnsemble, rows: int):
    """(tree, node, feature, cut, gain a row) of the splits of a small model."""
    out = [(t, n, model.cols[model.feature[t, n]], round(float(model.cut[t, n]), 6), round(float(model.gain[t, n]) / rows, 5))
           for t in range(model.trees) for n in range(model.feature.shape[1]) if model.feature[t, n] >= 0]
    return f.sparkSession.createDataFrame(out, "tree long, node long, feature string, cut double, gain double")


@query("m18_first_levels", two_levels("60 * ENGINE_LOAD + 30 * COOLANT_TEMP * O2_B1S2 + 10 * MAF", "mean - y", "1"))
def m18_levels(spark, sf):
    """The first two levels of the first boosted tree of the regressor."""
    f = target_rows(spark, sf)
    return first_levels(f, trees.boosted(f, SENSORS, "target", "value", 1, 2, 0.1), f.count()).drop("tree")


@query("m3_first_levels", two_levels("CASE WHEN ENGINE_LOAD + COOLANT_TEMP > 1.1 THEN 1 ELSE 0 END", "mean - y", "mean * (1 - mean)"))
def m3_levels(spark, sf):
    """The first two levels of the first boosted tree of the classifier."""
    f = fleet(spark, sf).select(*LINE_KEY, *SENSORS, (F.col("ENGINE_LOAD") + F.col("COOLANT_TEMP") > 1.1).cast("int").alias("y"))
    return first_levels(f, trees.boosted(f, SENSORS, "y", "logistic", 1, 2, 0.3), f.count()).drop("tree")


def times_sql(a: str, c: int) -> str:
    """Product modulo 2 to the 64."""
    return f"((({a})::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


BAGS = 5
_STEPS = ("30", 0xBF58476D1CE4E5B9), ("27", 0x94D049BB133111EB)
_POISSON = " + ".join(f"CASE WHEN u >= {float(p)!r} THEN 1 ELSE 0 END" for p in trees.POISSON)
BAGGED = f"""
WITH {FLEET}, t AS (SELECT {WHOLE_KEY_TEXT} AS k, {", ".join(SENSORS)}, 60 * ENGINE_LOAD + 30 * COOLANT_TEMP * O2_B1S2 + 10 * MAF AS y FROM fleet),
m AS (SELECT avg(y) AS mean, count(*) AS rows FROM t),
b AS (SELECT unnest(range({BAGS})) AS tree, unnest([{", ".join(f"{(42 * 1_000_003 + b + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1}::UBIGINT" for b in range(BAGS))}]) AS salt),
x0 AS (SELECT t.*, tree, (({{hash}}::UHUGEINT + salt::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM t, b),
x1 AS (SELECT * EXCLUDE (x), {times_sql("xor(x, x >> 30)", _STEPS[0][1])} AS x FROM x0),
x2 AS (SELECT * EXCLUDE (x), {times_sql("xor(x, x >> 27)", _STEPS[1][1])} AS x FROM x1),
x3 AS (SELECT * EXCLUDE (x), (xor(x, x >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM x2),
w AS (SELECT tree, ({_POISSON})::DOUBLE AS h, ({_POISSON}) * (mean - y) AS g, [{", ".join(SENSORS)}] AS xs FROM x3, m),
q AS ({" UNION ALL ".join(f"SELECT {j} AS j, unnest(list_distinct(quantile_cont({c}, [{', '.join(f'{i / 32}' for i in range(1, 32))}]))) AS cut FROM t" for j, c in enumerate(SENSORS))}),
s AS (SELECT tree, j, cut, sum(CASE WHEN xs[j + 1] <= cut THEN g ELSE 0 END) AS gl, sum(CASE WHEN xs[j + 1] <= cut THEN h ELSE 0 END) AS hl, sum(g) AS g, sum(h) AS h
  FROM w, q GROUP BY ALL)
SELECT tree, 0::BIGINT AS node, [{", ".join(f"'{c}'" for c in SENSORS)}][j + 1] AS feature, round(cut, 6) AS cut,
  round((gl * gl / hl + (g - gl) ** 2 / (h - hl) - g * g / h) / (SELECT rows FROM m), 5) AS gain
FROM s WHERE hl >= 1 AND h - hl >= 1 QUALIFY row_number() OVER (PARTITION BY tree ORDER BY gl * gl / hl + (g - gl) ** 2 / (h - hl) - g * g / h DESC, j, cut) = 1"""


@query("m17_first_level", BAGGED.replace("{hash}", "('0x' || substr(md5(k), 1, 15))::BIGINT"))
def m17_level(spark, sf):
    """The first split of each of a few bagged trees."""
    f = target_rows(spark, sf)
    return first_levels(f, trees.forest(f, SENSORS, "target", "value", BAGS, 1, key=WHOLE_KEY), f.count())


@query("m5_feature_importance_topk")
def m5(spark, sf):
    train, _ = split(spark, sf)
    return ml.feature_importance_topk(ml.random_forest_classifier(train, SENSORS, "need"), SENSORS, train)


RULE = """r AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p FROM lineitem)"""


def rule(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"))


@query("m6_evaluate_classifier", f"""
WITH {RULE}, c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn,
  count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM r)
SELECT round((tp + tn) / n::DOUBLE, 6) AS accuracy, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS auc,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def m6(spark, sf):
    return rounded(ml.evaluate_classifier(rule(spark, sf), "y", "p"))


@query("m6_classification_report", f"""
WITH {RULE}, k AS (SELECT unnest([0, 1]) AS c)
SELECT c::DOUBLE AS class, round(count(*) FILTER (y = c AND p = c) / count(*) FILTER (p = c)::DOUBLE, 6) AS precision,
  round(count(*) FILTER (y = c AND p = c) / count(*) FILTER (y = c)::DOUBLE, 6) AS recall,
  round(2 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (p = c) + count(*) FILTER (y = c))::DOUBLE, 6) AS f1,
  count(*) FILTER (y = c) AS support FROM r, k GROUP BY c""")
def m6_report(spark, sf):
    return rounded(ml.classification_report(rule(spark, sf), "y", "p"))


@query("m6_confusion_matrix", f"WITH {RULE} SELECT y AS actual, p AS predicted, count(*) AS n FROM r GROUP BY 1, 2")
def m6_matrix(spark, sf):
    return ml.confusion_matrix(rule(spark, sf), "y", "p")


@query("m7_compare_models", f"""
WITH {RULE}, two AS (SELECT 'quantity' AS model, y, p FROM r UNION ALL SELECT 'always', y, 1 FROM r),
c AS (SELECT model, count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 0) AS tn,
  count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM two GROUP BY model)
SELECT model, round((tp + tn) / n::DOUBLE, 6) AS accuracy, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS auc,
  round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""")
def m7(spark, sf):
    r = rule(spark, sf)
    return rounded(ml.compare_models({"quantity": r, "always": r.withColumn("p", F.lit(1))}, "y", "p"))


@query("m8_isolation_forest_flag", """
SELECT count(*) AS rows, round(sum(l_extendedprice), 2) AS price, true AS a_tenth FROM lineitem""")
def m8(spark, sf):
    """Every row gets a flag; those above the training quantile are a tenth, but for ties."""
    f = fleet(spark, sf).select(*LINE_KEY, *SENSORS)
    model = IsolationForest(SENSORS, LINE_KEY, trees=100).fit(f)
    flagged = F.avg((F.col("anomaly") == -1).cast("int"))
    return model.flag(f, f, 0.1, parts=tasks(spark)).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        flagged.between(0.09, 0.1001).alias("a_tenth"))


@query("m9_isolation_forest_score", """
SELECT l_orderkey, l_linenumber, count(*) AS rows, true AS in_range, (SELECT count(*) FROM lineitem) > 1 AS spans
FROM lineitem GROUP BY 1, 2""")
def m9(spark, sf):
    """Every row has a score; the scores span 0 to 100."""
    out = isolation_forest_score(fleet(spark, sf).select(*LINE_KEY, *SENSORS), SENSORS, LINE_KEY, trees=200, parts=tasks(spark))
    out = settle(out.select(*LINE_KEY, "MaintenanceNeed_IF"), "scored")
    ends = out.agg((F.min("MaintenanceNeed_IF") == 0).alias("lo"), (F.max("MaintenanceNeed_IF") == 100).alias("hi")).first()
    return out.groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_and(F.col("MaintenanceNeed_IF").between(0, 100)).alias("in_range"),
    ).withColumn("spans", F.lit(bool(ends["lo"] and ends["hi"])))


# ---- an isolation forest grown and scored by another engine

ISOLATED = ["ENGINE_LOAD", "COOLANT_TEMP", "TIMING_ADVANCE"]
FEW, DRAWN, SEED = 4, 64, 42


def hash60(text: str) -> str:
    """60 bits of an MD5."""
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"



def draw_sql(what: str) -> str:
    return f"({hash60(f"'{SEED}:' || tree || ':' || node || ':{what}'")}::DOUBLE / 1152921504606846976.0)"


_OPEN = "list_filter([" + ", ".join(f"CASE WHEN hi{i} > lo{i} THEN {i} END" for i in range(len(ISOLATED))) + "], lambda v: v IS NOT NULL)"
_X = ", ".join(f"x{i}" for i in range(len(ISOLATED)))
_ENDS = ", ".join(f"min(x{i}) OVER w AS lo{i}, max(x{i}) OVER w AS hi{i}" for i in range(len(ISOLATED)))
_DEPTH = 6  # binary logarithm of DRAWN
# a node with its rows' extremes: feature (null for a leaf) and cut
_CHOICE = f"""SELECT *, CASE WHEN n > 1 AND level < {_DEPTH} AND len({_OPEN}) > 0
      THEN {_OPEN}[floor({draw_sql('f')} * len({_OPEN}))::BIGINT + 1] END AS feature"""
_CUT = "(CASE feature " + " ".join(f"WHEN {i} THEN lo{i} + {draw_sql('c')} * (hi{i} - lo{i})" for i in range(len(ISOLATED))) + " END)"
_VALUE = "(CASE feature " + " ".join(f"WHEN {i} THEN x{i}" for i in range(len(ISOLATED))) + " END)"


def path_sql(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n}::DOUBLE WHEN {n} = 2 THEN 1 ELSE 0 END"


@query("m9_isolation_forest_replayed", f"""
WITH RECURSIVE {FLEET},
h AS (SELECT *, {", ".join(f"{c} AS x{i}" for i, c in enumerate(ISOLATED))}, {hash60(f"'{SEED}|' || {WHOLE_KEY_TEXT}")} AS h FROM fleet),
pool AS (SELECT {_X}, row_number() OVER (ORDER BY h, {", ".join(WHOLE_KEY)}) - 1 AS rank FROM h QUALIFY rank < {FEW * DRAWN}),
grow AS (
  SELECT (rank // {DRAWN})::BIGINT AS tree, 0::BIGINT AS node, 0 AS level, {_X} FROM pool
  UNION ALL
  SELECT tree, 2 * node + CASE WHEN {_VALUE} <= {_CUT} THEN 1 ELSE 2 END, level + 1, {_X}
  FROM ({_CHOICE} FROM (SELECT *, count(*) OVER w AS n, {_ENDS} FROM grow WINDOW w AS (PARTITION BY tree, node))) WHERE feature IS NOT NULL),
nodes AS (
  SELECT *, {_CUT} AS cut FROM ({_CHOICE} FROM (
    SELECT tree, node, any_value(level) AS level, count(*) AS n,
           {", ".join(f"min(x{i}) AS lo{i}, max(x{i}) AS hi{i}" for i in range(len(ISOLATED)))} FROM grow GROUP BY tree, node))),
walk AS (
  SELECT {", ".join(WHOLE_KEY)}, {_X}, t.tree, 0::BIGINT AS node, 0 AS level FROM h, (SELECT unnest(range({FEW})) AS tree) t
  UNION ALL
  SELECT {", ".join(WHOLE_KEY)}, {_X}, tree, 2 * node + CASE WHEN coalesce({_VALUE} > cut, false) THEN 2 ELSE 1 END, walk.level + 1
  FROM walk JOIN (SELECT tree, node, feature, cut FROM nodes WHERE feature IS NOT NULL) USING (tree, node)),
ends AS (
  SELECT {", ".join(WHOLE_KEY)}, {_X}, tree, walk.level + coalesce({path_sql('n')}, 0) AS steps
  FROM walk LEFT JOIN (SELECT tree, node, n, feature FROM nodes) USING (tree, node) WHERE feature IS NULL),
s AS (
  SELECT {", ".join(WHOLE_KEY)}, {_X}, pow(2, -avg(steps) / ({path_sql(str(DRAWN))})) AS score FROM ends GROUP BY ALL)
SELECT {", ".join(WHOLE_KEY)}, round(score, 6) AS score, CASE WHEN score > (SELECT quantile_cont(score, 0.9) FROM s) + 1e-9 THEN -1 ELSE 1 END AS anomaly
FROM s""")
def m9_replayed(spark, sf):
    """Scores and flags of every row from a forest that SQL can grow as well."""
    f = fleet(spark, sf).select(*WHOLE_KEY, *ISOLATED)
    model = IsolationForest(ISOLATED, WHOLE_KEY, trees=FEW, sample=DRAWN, seed=SEED).fit(f)
    scored = model.score(f.distinct(), "score")
    return model.flag(scored, scored, 0.1).select(*WHOLE_KEY, F.round("score", 6).alias("score"), "anomaly")


_N = len(SENSORS)
# the correlation matrix squared again and again tends to the first component's; the second follows after deflation
COMPONENTS = f"""{FLEET},
m AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS d{i}" for i, c in enumerate(SENSORS))} FROM fleet),
c AS (SELECT [{", ".join("[" + ", ".join(f"corr({a}, {b})" if a != b else "1::DOUBLE" for b in SENSORS) + "]" for a in SENSORS)}] AS c FROM fleet),
p AS (SELECT c, list_reduce(range(40), lambda a, i: {{squared}}, c) AS big FROM c),
v AS (SELECT c, {{column}} AS v1 FROM p),
w AS (SELECT v1, list_reduce(range(40), lambda a, i: {{squared}}, {{deflated}}) AS big FROM v),
z AS (SELECT v1, {{column}} AS v2 FROM w),
f AS (SELECT {{fixed1}} AS v1, {{fixed2}} AS v2 FROM z)"""
_ROW = f"range(1, {_N + 1})"
_SQUARED = (f"list_transform([[[list_dot_product(r, s) FOR s IN a] FOR r IN a]], "
            f"lambda b: [[y / list_sum([b[k][k] FOR k IN {_ROW}]) FOR y IN r] FOR r IN b])[1]")
# a symmetric matrix of rank one: its longest row, scaled
_COLUMN = ("list_transform([list_sort([{'l': list_dot_product(r, r), 'r': r} FOR r IN big], 'DESC')[1].r], "
           "lambda r: [y / sqrt(list_dot_product(r, r)) FOR y IN r])[1]")
_DEFLATED = f"[[c[i][j] - list_dot_product([list_dot_product(r, v1) FOR r IN c], v1) * v1[i] * v1[j] FOR j IN {_ROW}] FOR i IN {_ROW}]"


def _signed(v: str) -> str:
    return f"CASE WHEN list_max({v}) >= -list_min({v}) THEN {v} ELSE [-y FOR y IN {v}] END"


COMPONENTS = (COMPONENTS.replace("{squared}", _SQUARED).replace("{column}", _COLUMN).replace("{deflated}", _DEFLATED)
              .replace("{fixed1}", _signed("v1")).replace("{fixed2}", _signed("v2")))
_Z = "[" + ", ".join(f"({c} - m{i}) / d{i}" for i, c in enumerate(SENSORS)) + "]"


@query("m10_pca_project", f"""
WITH {COMPONENTS} SELECT {KEYS}, round(list_dot_product({_Z}, v1), 5) + 0.0 AS "PC1", round(list_dot_product({_Z}, v2), 5) + 0.0 AS "PC2" FROM fleet, m, f""")
def m10(spark, sf):
    out = ml.pca_project(fleet(spark, sf).select(*LINE_KEY, *SENSORS), SENSORS).select(*LINE_KEY, "PC1", "PC2")
    return out.withColumns({c: F.round(c, 5) + F.lit(0.0) for c in ("PC1", "PC2")})


@query("m11_pca_outlier_flag", f"""
WITH {COMPONENTS} SELECT abs(list_dot_product({_Z}, v1)) > 3 OR abs(list_dot_product({_Z}, v2)) > 3 AS pca_outlier, count(*) AS count
FROM fleet, m, f GROUP BY 1""")
def m11(spark, sf):
    out = ml.pca_outlier_flag(ml.pca_project(fleet(spark, sf).select(*SENSORS), SENSORS))
    return out.groupBy("pca_outlier").count()


@query("m12_kmeans_cluster")
def m12(spark, sf):
    return ml.kmeans_cluster(min_max(fleet(spark, sf).select(*SENSORS), SENSORS), SENSORS, 4).groupBy("cluster").count()


GROUPED = ["ENGINE_LOAD", "COOLANT_TEMP", "O2_B1S2"]
FIRST_CENTRES = [[0.2, 0.2, 0.2], [0.5, 0.5, 0.5], [0.8, 0.4, 0.8]]
ROUNDS = 5


LLOYD = ", ".join(
    f"""a{i} AS (SELECT f.*, row_number() OVER () AS r FROM g f),
b{i} AS (SELECT r, arg_min(c.k, {" + ".join(f"(f.{x} - c.{x}) ** 2" for x in GROUPED)}) AS k FROM a{i} f, c{i} c GROUP BY r),
c{i + 1} AS (SELECT k, {", ".join(f"avg({x}) AS {x}" for x in GROUPED)} FROM a{i} JOIN b{i} USING (r) GROUP BY k)""" for i in range(ROUNDS))
CLUSTERS = f"""{FLEET}, g AS (SELECT {", ".join(GROUPED)} FROM fleet),
c0(k, {", ".join(GROUPED)}) AS (VALUES {", ".join(f"({k}, {', '.join(f'{v}::DOUBLE' for v in row)})" for k, row in enumerate(FIRST_CENTRES))}),
{LLOYD}, last AS (SELECT row_number() OVER (ORDER BY {", ".join(GROUPED)}) - 1 AS k, {", ".join(GROUPED)} FROM c{ROUNDS}),
placed AS (SELECT f.*, row_number() OVER () AS r FROM g f),
own AS (SELECT r, arg_min(c.k, {" + ".join(f"(f.{x} - c.{x}) ** 2" for x in GROUPED)}) AS k FROM placed f, last c GROUP BY r)"""


@query("m12_kmeans_lloyd", f"""
WITH {CLUSTERS} SELECT k::INTEGER AS cluster, count(*) AS rows, {", ".join(f"round(avg({x}), 6) AS {x}" for x in GROUPED)}
FROM placed JOIN own USING (r) GROUP BY k""")
def m12_lloyd(spark, sf):
    """Clusters after a few Lloyd steps from given centres."""
    out = ml.kmeans_cluster(fleet(spark, sf).select(*GROUPED), GROUPED, 3, rounds=ROUNDS, start=FIRST_CENTRES)
    return out.groupBy("cluster").agg(F.count("*").alias("rows"), *[F.round(F.avg(x), 6).alias(x) for x in GROUPED])


@query("m13_silhouette")
def m13(spark, sf):
    clustered = ml.kmeans_cluster(min_max(fleet(spark, sf).select(*SENSORS), SENSORS), SENSORS, 3)
    return ml.silhouette(clustered, SENSORS)


@query("m13_silhouette_given_clusters", f"""
WITH {FLEET}, g AS (SELECT {", ".join(GROUPED)}, l_linenumber % 3 AS k FROM fleet),
s AS (SELECT k, count(*) AS n, {", ".join(f"avg({x}) AS m_{x}, var_pop({x}) AS v_{x}" for x in GROUPED)} FROM g GROUP BY k),
d AS (
  SELECT g.*, row_number() OVER () AS r FROM g),
t AS (
  SELECT d.r, d.k AS own, s.k AS k, s.n, {" + ".join(f"(d.{x} - m_{x}) ** 2 + v_{x}" for x in GROUPED)} AS far FROM d, s),
u AS (
  SELECT r, max(far * n / (n - 1)) FILTER (own = k) AS a, min(far) FILTER (own <> k) AS b FROM t GROUP BY r)
SELECT count(*) AS rows, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM u""")
def m13_given(spark, sf):
    """Mean silhouette of clusters by line number; SQL takes it from means and variances."""
    g = fleet(spark, sf).select(*GROUPED, (F.col("l_linenumber") % 3).alias("cluster"))
    return rounded(ml.silhouette(g, GROUPED))


@query("m14_adjusted_rand_index", """
WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS cells,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b,
  (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t)
SELECT round((cells - a * b / t) / ((a + b) / 2 - a * b / t), 8) AS ari FROM s""")
def m14(spark, sf):
    return rounded(ml.adjusted_rand_index(table(spark, sf, "lineitem"), "l_returnflag", "l_linenumber"), 8)


@query("m15_normalized_mutual_info", """
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT sum(n) AS t FROM c), ca AS (SELECT a, sum(n) AS na FROM c GROUP BY a), cb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b),
h AS (SELECT (SELECT -sum(na / t * ln(na / t)) FROM ca, t) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM cb, t) AS hb,
  (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN ca USING (a) JOIN cb USING (b), t) AS mi)
SELECT round(greatest(mi, 0) / ((ha + hb) / 2), 6) AS nmi FROM h""")
def m15(spark, sf):
    return rounded(ml.normalized_mutual_info(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


def with_gaps(spark, sf):
    """Fleet rows with about a tenth of the cells of three columns taken out."""
    def gap(c: str, by: int):
        return F.when((F.col("l_orderkey") * 7 + F.col("l_partkey") * by + F.col("l_linenumber")) % 10 > 0, F.col(c)).alias(c)

    return fleet(spark, sf).select(
        *LINE_KEY, gap("ENGINE_LOAD", 1), gap("COOLANT_TEMP", 3), gap("AIRFLOW_PER_RPM", 9), "MAF")


def gaps_sql(keep: str = "") -> str:
    """Present cells of ``with_gaps`` as sums, and the number of gaps, all of which must be filled."""
    cols = {"ENGINE_LOAD": 1, "COOLANT_TEMP": 3, "AIRFLOW_PER_RPM": 9}
    here = {c: f"(l_orderkey * 7 + l_partkey * {by} + l_linenumber) % 10 > 0" for c, by in cols.items()}
    sums = ", ".join(f"round(sum({c}) FILTER ({w}), 4) AS {c}, count(*) FILTER (NOT ({w})) AS gaps_{c}" for c, w in here.items())
    return f"WITH {FLEET} SELECT count(*) AS rows, {sums}, round(sum(MAF), 4) AS MAF, 0::BIGINT AS open{keep} FROM fleet"


def gaps_filled(before, after, *more):
    """The same figures from imputed rows next to the rows with gaps."""
    cols = ["ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_PER_RPM"]
    both = after.join(before.select(*LINE_KEY, *[F.col(c).isNotNull().alias(f"had_{c}") for c in cols]), LINE_KEY)
    out = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        out += [F.round(F.sum(F.when(F.col(f"had_{c}"), F.col(c))), 4).alias(c), F.count_if(~F.col(f"had_{c}")).alias(f"gaps_{c}")]
    still = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    return both.agg(*out, F.round(F.sum("MAF"), 4).alias("MAF"), F.sum(still).alias("open"), *more)


@query("m16_iterative_impute", gaps_sql())
def m16(spark, sf):
    """Present cells stay as they are and no gap is left."""
    rows = with_gaps(spark, sf)
    cols = ["ENGINE_LOAD", "COOLANT_TEMP", "AIRFLOW_PER_RPM", "MAF"]
    return gaps_filled(rows, IterativeImputer(cols).fit(rows).transform(rows))


@query("m16_impute_one_column", f"""
WITH {FLEET}, g AS (SELECT {", ".join(WHOLE_KEY)}, MAF, CASE WHEN (l_orderkey * 7 + l_partkey + l_linenumber) % 10 > 0 THEN ENGINE_LOAD + MAF / 3 END AS x FROM fleet),
r AS (SELECT regr_slope(x, MAF) AS a, regr_intercept(x, MAF) AS b FROM g)
SELECT {", ".join(WHOLE_KEY)}, round(coalesce(x, a * MAF + b), 6) AS x FROM g, r""")
def m16_one(spark, sf):
    """One column with gaps next to a whole one: every filled value is the line through the present ones."""
    gone = (F.col("l_orderkey") * 7 + F.col("l_partkey") + F.col("l_linenumber")) % 10 == 0
    f = fleet(spark, sf).select(*WHOLE_KEY, "MAF", F.when(~gone, F.col("ENGINE_LOAD") + F.col("MAF") / 3).alias("x"))
    return rounded(IterativeImputer(["x", "MAF"]).fit(f).transform(f).select(*WHOLE_KEY, "x"), 6)


def regression(spark, sf):
    return ml.train_test_split(target_rows(spark, sf), LINE_KEY)


@query("m17_random_forest_regressor")
def m17(spark, sf):
    train, test = regression(spark, sf)
    model = ml.random_forest_regressor(train, SENSORS, "target")
    return ml.regression_metrics(ml.predict(model, test), "target", "prediction")


@query("m18_boosted_tree_regressor")
def m18(spark, sf):
    train, test = regression(spark, sf)
    model = ml.boosted_tree_regressor(train, SENSORS, "target")
    return ml.regression_metrics(ml.predict(model, test), "target", "prediction")


@query("m19_regression_metrics", f"""
WITH {FLEET}, p AS (SELECT COOLANT_TEMP AS y, ENGINE_LOAD AS p FROM fleet)
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM p""")
def m19(spark, sf):
    return rounded(ml.regression_metrics(fleet(spark, sf), "COOLANT_TEMP", "ENGINE_LOAD"))


@query("m20_tte_regressor")
def m20(spark, sf):
    train, test = regression(spark, sf)
    model = ml.tte_regressor(train, SENSORS, "target")
    return ml.regression_metrics(ml.predict(model, test), "target", "prediction")


@query("m21_rbf_outlier_flag")
def m21(spark, sf):
    return rbf_outlier_flag(fleet(spark, sf).select(*SENSORS), SENSORS).groupBy("outlier").count()
