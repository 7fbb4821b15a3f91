"""Cleaning jobs: K1 session, K2 trials, K11 external drive files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import outside_to_null, row_mean, safe_ratio, sentinel_to_null
from torqueline.functions.text import parse_timestamp
from torqueline.operators.columns import (
    drop_constant_and_identical, drop_sparse_columns, has_columns, normalise_column_names,
    numeric_columns,
)
from torqueline.operators.joins import union_logs
from torqueline.operators.profile import correlation
from torqueline.operators.rows import (
    PHYSICAL_RANGES, distinct_rows, drop_rows_missing_over_ratio, range_filter, require_n_present,
)
from torqueline.operators.scaling import fill, median_fill_and_scale
from torqueline.operators.sequence import forward_fill, row_index
from torqueline.operators.timeline import timeline
from torqueline.schema import TREND_SIGNALS
from torqueline.session import settle

# Plausible engine speed.
RPM_RANGE = (100, 6000)


def without_sentinels(df: DataFrame) -> DataFrame:
    return df.withColumns({c: sentinel_to_null(c) for c in numeric_columns(df)})


def derive(df: DataFrame) -> DataFrame:
    """Combined load, temperature and airflow columns where their inputs survived."""
    new = {}
    if has_columns(df, ["ENGINE_LOAD", "ABSOLUTE_LOAD"]):
        new["AVG_ENGINE_LOAD"] = row_mean("ENGINE_LOAD", "ABSOLUTE_LOAD")
    if has_columns(df, ["INTAKE_TEMP", "OIL_TEMP", "COOLANT_TEMP"]):
        new["TEMP_MEAN"] = row_mean("INTAKE_TEMP", "OIL_TEMP", "COOLANT_TEMP")
    if has_columns(df, ["MAF", "RPM"]):
        new["AIRFLOW_PER_RPM"] = safe_ratio("MAF", "RPM")
    return df.withColumns(new)


def prune_session(df: DataFrame, ts: str = "timestamp", protect: Sequence[str] = ("timestamp", "driving_style"),
                  protect_all: bool = False) -> DataFrame:
    """Column and row pruning of a session, up to plausible engine speed; values unscaled."""
    df = drop_constant_and_identical(df, protect)
    df = without_sentinels(distinct_rows(df))
    # the deduplicated rows feed three statistics jobs and the result: shuffle them once
    df = settle(drop_rows_missing_over_ratio(df, 0.8, ts), "session")
    df = drop_sparse_columns(df, 0.8, protect if protect_all else ())
    df = require_n_present(df, 2, ts)
    if "RPM" in df.columns:
        df = df.withColumn("RPM", outside_to_null("RPM", *RPM_RANGE))
    return df


def clean_session(df: DataFrame, ts: str = "timestamp", protect: Sequence[str] = ("timestamp", "driving_style"),
                  protect_all: bool = False) -> DataFrame:
    """Pruned, median-filled, scaled to [0, 1], with derived columns.

    Rows come unordered; sort them where they are presented.
    """
    df = prune_session(df, ts, protect, protect_all)
    return derive(median_fill_and_scale(df, numeric_columns(df)))


def trend_table(df: DataFrame, ts: str = "timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Sample index against the trend sensors that are there.

    Without ``tie`` rows of one time are ordered by their values, so that only equal rows are interchangeable.
    """
    tl = row_index(timeline(df, ts, tie=tie or [c for c in df.columns if c != ts]), "sample")
    return tl.frame.select("sample", *[c for c in TREND_SIGNALS if c in df.columns])


def session_report(cleaned: DataFrame, ts: str = "timestamp", tie: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Correlation of the numeric columns and the trend table."""
    return correlation(cleaned), trend_table(cleaned, ts, tie)


def clean_trials(trials: Sequence[DataFrame]) -> DataFrame:
    """Trial logs on their common columns; engine speed is filled before and after its range check."""
    df = union_logs(trials, "common")
    df = drop_constant_and_identical(df)
    df = settle(without_sentinels(distinct_rows(df)), "trials")
    df = drop_sparse_columns(df, 0.8)
    df = fill(df, numeric_columns(df), "median")
    if "RPM" in df.columns:
        df = df.withColumn("RPM", outside_to_null("RPM", *RPM_RANGE))
    return derive(median_fill_and_scale(df, numeric_columns(df)))


def clean_drive_files(df: DataFrame, time: str = "Time", partition_by: Sequence[str] = (), tie: Sequence[str] = (),
                      ranges: dict = PHYSICAL_RANGES) -> DataFrame:
    """External drive files: names, time of day, forward fill in file order, physical ranges.

    ``tie`` gives the file order (source file, block, row number); the fill runs in that
    order, not by the time of day, which starts again in every file.
    """
    df = normalise_column_names(df)
    if time in df.columns and dict(df.dtypes)[time] == "string":
        df = df.withColumn(time, parse_timestamp(time, "HH:mm:ss.SSS", "HH:mm:ss.SSSSSS", "HH:mm:ss"))
    first, *rest = tie or (time,)
    tl = timeline(df, first, partition_by, rest)
    fixed = {first, *rest, *partition_by}
    tl = forward_fill(tl, [c for c in df.columns if c not in fixed])
    return range_filter(tl.frame, ranges)
