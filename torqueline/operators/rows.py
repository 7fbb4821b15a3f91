"""Row filters, deduplication, updates, order and sampling: P8-P16, G20, G21, O1-O4."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from torqueline.functions.numeric import missing_count

# Closed ranges of physically possible readings.
PHYSICAL_RANGES = {
    "Engine Coolant Temperature °C": (-40, 130),
    "Vehicle Speed Sensor km/h": (0, 250),
    "Engine RPM RPM": (0, 8000),
}


def range_filter(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = PHYSICAL_RANGES) -> DataFrame:
    """Keep rows with every listed column inside its closed range; a missing value fails."""
    inside = [F.col(f"`{c}`").between(lo, hi) for c, (lo, hi) in ranges.items()]
    return df.filter(reduce(lambda a, b: a & b, inside))


def drop_rows_missing_over_ratio(df: DataFrame, ratio: float = 0.8, ts: str = "timestamp") -> DataFrame:
    """Keep rows whose missing count, the timestamp aside, is at most ``int(ratio * other columns)``."""
    cols = [c for c in df.columns if c != ts]
    return df.filter(missing_count(cols) <= F.lit(int(ratio * (len(df.columns) - 1))))


def drop_rows_missing_over_n(df: DataFrame, most: int = 4) -> DataFrame:
    return df.filter(missing_count(df.columns) <= F.lit(most))


def require_n_present(df: DataFrame, least: int = 2, ts: str = "timestamp") -> DataFrame:
    cols = [c for c in df.columns if c != ts]
    return df.dropna(thresh=least, subset=cols) if cols else df.filter(F.lit(least <= 0))


def require_any_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna("all", subset=[c for c in cols if c in df.columns])


def dropna(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=subset)


def mask_filter(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def conditional_update(df: DataFrame, col: str, where: Column, value) -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(col, F.when(where, value).otherwise(F.col(col)))


def row_hash(names: Sequence[str], seed: int | None = None) -> Column:
    """60 bits of the MD5 of the columns' text, joined with bars, null as empty; any engine can repeat it."""
    parts = [F.lit(str(seed))] if seed is not None else []
    text = F.concat_ws("|", *parts, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, draw: Column | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), those first in hash order of ``key``: repeatable under any partitioning.

    A top-n would gather ``n`` rows from every task.  Hash values are spread evenly, so
    rows above a value that about ``2 n`` rows stay below are left out first; the bound
    is raised if chance leaves too few.  ``key`` must be unique for an even sample.  The hash is XXH64
    of seed and key, or ``draw``, which is one of 60 bits such as :func:`row_hash`.
    """
    low, width = (0, 1 << 60) if draw is not None else (-(1 << 63), 1 << 64)
    draw = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key]) if draw is None else draw
    rows = df.count()
    if rows <= n:
        return df

    def first(some: DataFrame) -> DataFrame:
        # the hash as a column, or every comparison of two rows takes it anew
        return some.withColumn("__draw", draw).orderBy("__draw", *key).limit(n).drop("__draw")

    share = (2 * n + 100) / rows
    while share < 1:
        few = df.filter(draw < F.lit(low + int(share * width)))
        if few.count() >= n:
            return first(few)
        share *= 2
    return first(df)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_by_key_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order.

    Spark keeps only the best row of each key per map task before the shuffle
    (WindowGroupLimit), so a key holding much of the table is no hot spot.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") == 1).drop("__rn")


def sort_by_time(df: DataFrame, ts: str = "timestamp", tie: Iterable[str] = ()) -> DataFrame:
    return df.orderBy(ts, *tie)


def top_k_desc(df: DataFrame, score: str, k: int = 15, tie: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(score), *tie).limit(k)


def n_largest(df: DataFrame, score: str, key: Sequence[str], n: int = 10) -> DataFrame:
    return top_k_desc(df.filter(F.col(score).isNotNull()), score, n, key)


def head(df: DataFrame, n: int, order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    out = df.orderBy(*order).limit(n)
    return out.select(*[c for c in cols if c in df.columns]) if cols else out
