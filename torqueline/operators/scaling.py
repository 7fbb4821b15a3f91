"""Fills and scalings whose constants come from the data: F6-F8, F16-F19."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions import sql
from torqueline.functions.numeric import (
    clip, fill_value, scaled_between, standardised, stress_two_sided, stress_upper, weighted_index,
)
from torqueline.operators.columns import column_extremes
from torqueline.operators.quantiles import exact_quantiles, medians


def fill(df: DataFrame, cols: Sequence[str], how="median") -> DataFrame:
    """Fill missing values with the column median, mean or a constant.

    Columns without gaps keep their type and cost no statistics.
    """
    if not cols:
        return df
    if how not in ("median", "mean"):
        return df.withColumns({c: fill_value(c, how) for c in cols})
    row = df.selectExpr(*[
        f"struct(count_if({sql.name(c)} IS NULL), avg({sql.name(c)})) AS s{i}" for i, c in enumerate(cols)
    ]).first()
    gappy = {c: row[i][1] for i, c in enumerate(cols) if row[i][0]}
    by = gappy if how == "mean" else medians(df, list(gappy))
    return df.withColumns({c: fill_value(c, v) for c, v in by.items() if v is not None})


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0, missing stays missing."""
    ends = column_extremes(df, list(cols))
    return df.withColumns({f"{c}{suffix}": scaled_between(c, lo, hi) for c, (_, lo, hi) in ends.items()})


def median_fill_and_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """:func:`fill` with medians, then :func:`min_max`.

    A median lies between the extremes, so the bounds can be taken before the fill and
    share a job with the gap counts.
    """
    if not cols:
        return df
    row = df.selectExpr(*[
        f"struct(count_if({x} IS NULL), min({x}), max({x})) AS s{i}" for i, x in enumerate(map(sql.name, cols))
    ]).first()
    stats = {c: tuple(row[i]) for i, c in enumerate(cols)}
    by = medians(df, [c for c in cols if stats[c][0] and stats[c][1] is not None])
    return df.withColumns({
        c: scaled_between(fill_value(c, by[c]) if c in by else c, lo, hi) for c, (_, lo, hi) in stats.items()
    })


def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float | None, float | None]]:
    """(mean, population deviation) per column, one job."""
    if not cols:
        return {}
    row = df.selectExpr(*[
        f"struct(avg({x}), stddev_pop({x})) AS s{i}" for i, x in enumerate(map(sql.name, cols))
    ]).first()
    return {c: tuple(row[i]) for i, c in enumerate(cols)}


def standardise(df: DataFrame, cols: Sequence[str], suffix: str = "", fitted: Mapping | None = None) -> DataFrame:
    """Z-scores; ``fitted`` takes the moments of another frame (train only)."""
    stats = fitted or moments(df, cols)
    return df.withColumns({f"{c}{suffix}": standardised(c, *stats[c]) for c in cols})


def cap_at_quantile(df: DataFrame, col: str, out: str, q: float = 0.99, scaled: str | None = None) -> DataFrame:
    """Clamp above at quantile ``q``; optionally also that column scaled to [0, 1]."""
    top = exact_quantiles(df, {col: [q]})[col, q]
    df = df.withColumn(out, clip(col, hi=top) if top is not None else F.col(col))
    if scaled:
        lo = column_extremes(df, [out])[out]
        df = df.withColumn(scaled, scaled_between(out, lo[1], lo[2]))
    return df


def add_stress(df: DataFrame, upper: Mapping[str, str], two_sided: Mapping[str, str], hi: float = 0.9,
               lo: float = 0.1) -> DataFrame:
    """Stress columns ``{out: col}`` against the column's own quantiles, one quantile job."""
    wanted: dict[str, list[float]] = {}
    for c in upper.values():
        wanted.setdefault(c, []).append(hi)
    for c in two_sided.values():
        wanted[c] = list(dict.fromkeys([*wanted.get(c, []), lo, hi]))
    at = exact_quantiles(df, wanted)
    out = {}
    for name, c in upper.items():
        out[name] = F.lit(0.0) if at[c, hi] is None else stress_upper(c, at[c, hi])
    for name, c in two_sided.items():
        out[name] = F.lit(0.0) if at[c, lo] is None else stress_two_sided(c, at[c, lo], at[c, hi])
    return df.withColumns(out)


def add_weighted_index(df: DataFrame, weights: Mapping[str, float], index: str = "HealthIndex",
                       score: str = "MaintenanceNeed") -> DataFrame:
    """Weighted sum and its 0-100 score, two places, half to even."""
    df = df.withColumn(index, weighted_index(weights))
    return df.withColumn(score, clip(F.bround(F.col(index) * F.lit(100.0), 2), 0, 100))
