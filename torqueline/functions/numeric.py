"""Scalar rules on numbers, all as built-in Column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from torqueline.functions import sql

__all__ = [
    "SENTINELS", "nan_to_null", "to_number", "sentinel_to_null", "outside_to_null", "fill_value",
    "row_mean", "safe_ratio", "eps_ratio", "pair_mean", "kph_to_mps", "mps2_to_g", "days_since",
    "days_until", "clip", "scaled_between", "standardised", "stress_upper", "stress_two_sided",
    "weighted_index", "missing_count", "rate", "rolling_std_of",
]

# Sensor codes that stand for "no reading".
SENTINELS = (-22, -40, 255)

KPH_TO_MPS = 1 / 3.6
STANDARD_GRAVITY = 9.80665
DAY_MICROS = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def to_number(c: Column | str) -> Column:
    """Text to double; what is not a number becomes NULL, and so does NaN."""
    c = _col(c).cast("string")
    # Java's parser would also take type suffixes such as "1.5d"
    return nan_to_null(F.when(~c.rlike(r"[0-9.][dDfF]\s*$"), c).try_cast("double"))


def sentinel_to_null(c: Column | str, codes: tuple = SENTINELS) -> Column:
    c = _col(c)
    return F.when(~c.isin(*codes), c)


def outside_to_null(c: Column | str, lo: float, hi: float) -> Column:
    c = _col(c)
    return F.when(c.between(lo, hi), c)


def fill_value(c: Column | str, value) -> Column:
    return F.coalesce(_col(c), value if isinstance(value, Column) else F.lit(value))


def missing_count(cols: list[str]) -> Column:
    return F.expr(" + ".join(["0", *[f"CAST({sql.name(c)} IS NULL AS INT)" for c in cols]]))


def row_mean(*cols: Column | str) -> Column:
    """Mean across columns with missing values skipped."""
    cols = [_col(c) for c in cols]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(_col(a), _col(b))


def eps_ratio(a: Column | str, b: Column | str, eps: float = 1e-3) -> Column:
    return F.try_divide(_col(a), _col(b) + F.lit(eps))


def pair_mean(a: Column | str, b: Column | str) -> Column:
    """Plain mean of two columns, missing if either is (unlike :func:`row_mean`)."""
    return (_col(a) + _col(b)) / F.lit(2.0)


def kph_to_mps(c: Column | str) -> Column:
    return _col(c) * F.lit(KPH_TO_MPS)


def mps2_to_g(c: Column | str) -> Column:
    return _col(c) / F.lit(STANDARD_GRAVITY)


def rate(value: Column, previous: Column, seconds: Column) -> Column:
    """Change per second; no previous row, a zero gap or a missing value give 0."""
    return F.coalesce(F.try_divide(value - previous, seconds), F.lit(0.0))


def rolling_std_of(values: list[Column]) -> Column:
    """Sample deviation of the present values of a short frame, 0 below two values."""
    count = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    mean = row_mean(*values)
    squares = reduce(lambda a, b: a + b, [F.coalesce((v - mean) * (v - mean), F.lit(0.0)) for v in values])
    return F.coalesce(F.sqrt(F.when(count > 1, F.try_divide(squares, count - 1))), F.lit(0.0))


def _whole_days(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return F.floor(micros / F.lit(DAY_MICROS)).cast("long")


def days_since(d: Column | str, as_of: date | datetime) -> Column:
    return _whole_days(F.lit(as_of), _col(d))


def days_until(d: Column | str, as_of: date | datetime) -> Column:
    return _whole_days(_col(d), F.lit(as_of))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp; NULL stays NULL (``greatest`` alone would replace it by the bound)."""
    c = _col(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def scaled_between(c: Column | str, lo: float | None, hi: float | None) -> Column:
    """Min-max scaling with known bounds; a constant column scales to 0."""
    c = _col(c)
    if lo is None or hi is None:
        return F.lit(None).cast("double")
    if hi == lo:
        return F.when(c.isNotNull(), F.lit(0.0))
    return (c - F.lit(float(lo))) / F.lit(float(hi) - float(lo))


def standardised(c: Column | str, mean: float | None, std: float | None) -> Column:
    """Z-score with the population deviation; a constant column becomes 0."""
    c = _col(c)
    if mean is None:
        return F.lit(None).cast("double")
    return (c - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)


def _unit(numerator: Column, denominator: float) -> Column:
    """Positive numerator over a constant, clamped to [0, 1]; x/0 counts as full stress."""
    if denominator == 0:
        return F.lit(1.0)
    return F.least(F.greatest(numerator / F.lit(float(denominator)), F.lit(0.0)), F.lit(1.0))


def stress_upper(c: Column | str, threshold: float) -> Column:
    """0 up to the threshold, then rising to 1 at value 1; missing counts as no stress."""
    c = _col(c)
    return F.when(c > threshold, _unit(c - F.lit(threshold), 1.0 - threshold)).otherwise(F.lit(0.0))


def stress_two_sided(c: Column | str, lo: float, hi: float) -> Column:
    """Relative distance outside ``[lo, hi]`` clamped to [0, 1]; missing counts as no stress."""
    c = _col(c)
    return (
        F.when(c < lo, _unit(F.lit(lo) - c, lo))
        .when(c > hi, _unit(c - F.lit(hi), 1.0 - hi))
        .otherwise(F.lit(0.0))
    )


def weighted_index(weights: Mapping[str, float]) -> Column:
    """Sum of weighted parts in [0, 1]; a missing part adds nothing."""
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in weights.items()]
    return reduce(lambda a, b: a + b, parts)
