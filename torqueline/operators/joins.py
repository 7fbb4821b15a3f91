"""Unions and joins: U1, S4, J1-J5.

No join carries a broadcast hint: adaptive execution broadcasts a side whose measured
size is small and splits a sort-merge partition that one key has swollen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.operators.columns import schema_intersection
from torqueline.operators.rows import dedup_by_key_first


def union_logs(dfs: Sequence[DataFrame], how: str = "outer") -> DataFrame:
    """Bag union by name over all columns (``outer``) or the shared ones (``common``)."""
    if how == "common":
        shared = schema_intersection(dfs)
        dfs = [d.select(*shared) for d in dfs]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def inner_equi_join(left: DataFrame, right: DataFrame, on: str, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join on one key; columns both sides have get a suffix."""
    clash = (set(left.columns) & set(right.columns)) - {on}
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left.join(right, on)


def left_equi_join(readings: DataFrame, labels: DataFrame, on: str, order: Sequence[str]) -> DataFrame:
    """First reading per key with the first label of that key, if any."""
    return dedup_by_key_first(readings, [on], order).join(
        dedup_by_key_first(labels, [on], order).select(on, *[c for c in labels.columns if c not in readings.columns]),
        on, "left",
    )


def semi_join_flag(df: DataFrame, chosen: DataFrame, on: Sequence[str], flag: str = "chosen") -> DataFrame:
    """Mark rows whose key is in ``chosen``."""
    marks = chosen.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(marks, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def row_aligned_lookup(features: DataFrame, source: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Bring a column back to rows that were derived from ``source``, by row key."""
    return features.join(source.select(*key, column), list(key), "left")


def column_concat(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two tables side by side on their common row key."""
    return a.join(b, key, "full")
