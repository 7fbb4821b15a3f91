"""Profiling tables: G2-G19.

Whole-frame statistics are one aggregate over all columns; its single row is then
unfolded into one row per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torqueline.functions import sql
from torqueline.functions.numeric import scaled_between
from torqueline.operators.columns import column_extremes, numeric_columns, text_columns
from torqueline.operators.quantiles import exact_quantiles, quantile_exprs

# Shares shown in the quantile table.
TABLE_QUANTILES = (0, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0)

PAIRS_PER_JOB = 300


def _unfold(df: DataFrame, aggregates: Mapping[str, str], rows: Sequence[str]) -> DataFrame:
    """One aggregate row to several: ``rows`` are SQL structs over the aggregate's columns."""
    one = df.selectExpr(*[f"{e} AS {n}" for n, e in aggregates.items()])
    return one.selectExpr(f"inline(array({', '.join(rows)}))")


def value_counts_pct(df: DataFrame, label: str) -> DataFrame:
    """Count and percentage per label, missing counted as a label, largest first."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # over one row per label, not a second scan
    return counts.withColumn("percentage", F.try_divide(F.col("count") * F.lit(100.0), total)).orderBy(
        F.desc("count"), F.asc_nulls_last(label)
    )


def conditional_proportion(df: DataFrame, label: str = "driving_style", value: str = "idle") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) == value).alias("matching"), F.count(F.lit(1)).alias("total")
    ).withColumn("proportion", F.try_divide(F.col("matching"), F.col("total")))


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per numeric column."""
    cols = list(cols or numeric_columns(df))
    quartiles = quantile_exprs(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggregates, rows = {}, []
    for i, c in enumerate(cols):
        x = sql.name(c)
        parts = {
            "count": f"count({x})",
            "mean": f"avg({x})",
            "std": f"stddev_samp({x})",
            "min": f"CAST(min({x}) AS DOUBLE)",
            "q25": quartiles[c, 0.25],
            "q50": quartiles[c, 0.5],
            "q75": quartiles[c, 0.75],
            "max": f"CAST(max({x}) AS DOUBLE)",
        }
        aggregates |= {f"{n}_{i}": e for n, e in parts.items()}
        rows.append(sql.struct(column=sql.text(c), **{n: f"{n}_{i}" for n in parts}))
    return _unfold(df, aggregates, rows)


def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value (ties: smallest) and its count per text column."""
    cols = list(cols or text_columns(df))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in cols]))
    freq = (
        df.select(cells.alias("x")).filter(F.col("x.v").isNotNull())
        .groupBy(F.col("x.column").alias("column"), F.col("x.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return freq.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"), F.max("n").alias("freq"))


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric and text summaries in one table; what does not apply is NULL."""
    parts = []
    if numeric_columns(df):
        parts.append(describe_numeric(df))
    if text_columns(df):
        parts.append(describe_text(df))
    if len(parts) == 2:
        return parts[0].unionByName(parts[1], allowMissingColumns=True)
    return parts[0]


def missing_profile(df: DataFrame, top: int | None = None, only_missing: bool = True) -> DataFrame:
    """Missing count and share per column, most first."""
    names = df.columns
    out = _unfold(
        df,
        {"n": "count(1)"} | {f"m{i}": f"count_if({sql.name(c)} IS NULL)" for i, c in enumerate(names)},
        [sql.struct(column=sql.text(c), missing=f"m{i}", share=f"try_divide(m{i}, n)") for i, c in enumerate(names)],
    )
    if only_missing:
        out = out.filter(F.col("missing") > 0)
    out = out.orderBy(F.desc("missing"), "column")
    return out.limit(top) if top else out


def dataset_profile(df: DataFrame, by: str | None = None) -> DataFrame:
    """Row and column counts, per file or group if ``by`` is given."""
    grouped = df.groupBy(by) if by else df.groupBy()
    width = len(df.columns) - (1 if by else 0)
    return grouped.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(width).cast("long"))


def column_types(df: DataFrame) -> list[tuple[str, str]]:
    return df.dtypes


def median_per_column(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return quantile_per_column(df, cols, 0.5, "median")


def quantile_per_column(df: DataFrame, cols: Sequence[str], q: float, out: str = "value") -> DataFrame:
    at = quantile_exprs(df, {c: [q] for c in cols})
    return _unfold(
        df, {f"q{i}": e for i, e in enumerate(at.values())},
        [sql.struct(column=sql.text(c), **{out: f"q{i}"}) for i, (c, _) in enumerate(at)],
    )


def mean_per_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _unfold(
        df, {f"m{i}": f"avg({sql.name(c)})" for i, c in enumerate(cols)},
        [sql.struct(column=sql.text(c), mean=f"m{i}") for i, c in enumerate(cols)],
    )


def quantile_table(df: DataFrame, scores: Mapping[str, str], quantiles: Sequence[float] = TABLE_QUANTILES) -> DataFrame:
    """One row per quantile, one column per score (``{output name: column}``)."""
    qs = [float(q) for q in quantiles]
    at = quantile_exprs(df, {c: qs for c in scores.values()})
    names = {key: f"q{i}" for i, key in enumerate(at)}
    return _unfold(
        df, {names[k]: e for k, e in at.items()},
        [sql.struct(quantile=sql.number(q), **{n: names[c, q] for n, c in scores.items()}) for q in qs],
    )


def resample_mean(df: DataFrame, ts: str, cols: Sequence[str], unit: str = "hour") -> DataFrame:
    """Mean per time unit; units without rows are present with NULL."""
    kind = df.schema[ts].dataType
    bucket = F.date_trunc(unit, F.col(ts)).cast(kind)
    means = df.filter(F.col(ts).isNotNull()).groupBy(bucket.alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])
    lo, hi = df.agg(F.min(bucket), F.max(bucket)).first()
    if lo is None:
        return means
    step = F.expr(f"interval 1 {unit}")
    units = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(lo).cast(kind), F.lit(hi).cast(kind), step)).alias(ts)
    )
    return units.join(means, ts, "left")


def _pearson(x: str, y: str) -> str:
    """Correlation over rows with both present; NULL, not an error, for a constant column."""
    spread = f"stddev_pop(IF({y} IS NULL, NULL, {x})) * stddev_pop(IF({x} IS NULL, NULL, {y}))"
    return f"try_divide(covar_pop({x}, {y}), {spread})"


def _double(c: str) -> str:
    return f"CAST({sql.name(c)} AS DOUBLE)"


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(x, y, r)``, both triangles and the diagonal."""
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    parts = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        chunk = pairs[start:start + PAIRS_PER_JOB]
        rows = []
        for i, (a, b) in enumerate(chunk):
            ends = [(a, b)] if a == b else [(a, b), (b, a)]
            rows += [sql.struct(x=sql.text(p), y=sql.text(q), r=f"r{i}") for p, q in ends]
        parts.append(_unfold(df, {f"r{i}": _pearson(_double(a), _double(b)) for i, (a, b) in enumerate(chunk)}, rows))
    return reduce(DataFrame.unionAll, parts)


def strong_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    return matrix.filter((F.abs("r") > threshold) & (F.col("x") < F.col("y")))


def point_biserial(df: DataFrame, cols: Sequence[str], target: Column | str) -> DataFrame:
    """Correlation of each feature with a 0/1 target."""
    df = df.withColumn("__y", (F.col(target) if isinstance(target, str) else target).cast("double"))
    return _unfold(
        df, {f"r{i}": _pearson(_double(c), "__y") for i, c in enumerate(cols)},
        [sql.struct(column=sql.text(c), r=f"r{i}") for i, c in enumerate(cols)],
    )


def chi2_scores(df: DataFrame, cols: Sequence[str], label: str, scale: bool = True) -> DataFrame:
    """Chi-square of class sums against class shares, per non-negative feature.

    With class sums o, class sizes n, feature total T and N rows the statistic
    sum((o - e)^2 / e), e = T n / N, equals N / T * sum(o^2 / n) - T, so one pass over
    the per-class sums is enough.
    """
    value = {c: F.col(c).cast("double") for c in cols}
    if scale:
        value = {c: scaled_between(c, lo, hi) for c, (_, lo, hi) in column_extremes(df, list(cols)).items()}
    classes = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"o{i}") for i, v in enumerate(value.values())]
    )
    sums = {"n": "sum(n)"}
    for i in range(len(cols)):
        sums |= {f"t{i}": f"sum(o{i})", f"s{i}": f"sum(o{i} * o{i} / n)"}
    return _unfold(
        classes, sums,
        [sql.struct(column=sql.text(c), chi2=f"try_divide(n * s{i}, t{i}) - t{i}") for i, c in enumerate(cols)],
    )


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bin counts, empty bins included; the last bin is closed."""
    n, lo, hi = column_extremes(df, [col])[col]
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, lo double, hi double, n long")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col(col).cast("double") - F.lit(lo)) / F.lit(width)).cast("long"), F.lit(bins - 1).cast("long"))
    counts = df.filter(F.col(col).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(lo) + F.col("id") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("id") + 1) * F.lit(width)).alias("hi"),
    )
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def kde_curve(df: DataFrame, col: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid from min to max, Scott's bandwidth.

    Equal values are counted first; each distinct value then adds its share to every
    grid point within its own task, so only ``points`` sums leave a task.
    """
    n, lo, hi, std = df.agg(
        F.count(col), F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double")), F.stddev_samp(F.col(col).cast("double"))
    ).first()
    if not n or not std:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = std * n ** (-0.2)
    step = (hi - lo) / (points - 1)
    values = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("m"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    at = F.lit(lo) + F.col("i") * F.lit(step)
    z = (at - F.col("v")) / F.lit(h)
    scale = n * h * (2 * 3.141592653589793) ** 0.5
    return (
        values.select("v", "m", grid)
        .groupBy("i").agg((F.sum(F.col("m") * F.exp(-z * z / 2)) / F.lit(scale)).alias("density"))
        .select(at.alias("x"), "density")
    )


def box_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the extreme values within 1.5 IQR, and outlier counts."""
    at = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols})
    aggregates, rows = {}, []
    for i, c in enumerate(cols):
        q1, q2, q3 = (at[c, q] for q in (0.25, 0.5, 0.75))
        if q1 is None:
            continue
        reach = 1.5 * (q3 - q1)
        x = _double(c)
        inside = f"{x} BETWEEN {sql.number(q1 - reach)} AND {sql.number(q3 + reach)}"
        aggregates |= {
            f"lo{i}": f"min(IF({inside}, {x}, NULL))", f"hi{i}": f"max(IF({inside}, {x}, NULL))",
            f"n{i}": f"count_if(NOT ({inside}))",
        }
        rows.append(sql.struct(
            column=sql.text(c), q25=sql.number(q1), q50=sql.number(q2), q75=sql.number(q3),
            whisker_lo=f"lo{i}", whisker_hi=f"hi{i}", outliers=f"n{i}",
        ))
    return _unfold(df, aggregates, rows)
