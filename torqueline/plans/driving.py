"""Driving-style analysis, K10."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import to_number
from torqueline.functions.text import parse_timestamp
from torqueline.operators.columns import ensure_columns
from torqueline.operators.profile import value_counts_pct
from torqueline.operators.sequence import Thresholds, driving_style, fill_and_rate
from torqueline.operators.timeline import ROWS_PER_SLAB, timeline

SIGNALS = ["SPEED", "RPM", "THROTTLE_POS"]


def numeric_signals(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    df = ensure_columns(df, SIGNALS)
    kinds = dict(df.dtypes)
    if kinds[ts] == "string":
        df = df.withColumn(ts, parse_timestamp(ts))
    return df.withColumns({c: to_number(c) if kinds[c] == "string" else F.col(c).cast("double") for c in SIGNALS})


def analyse_driving(df: DataFrame, ts: str = "timestamp", partition_by: Sequence[str] = (), tie: Sequence[str] = (),
                    limits: Thresholds = Thresholds(), rows_per_slab: int = ROWS_PER_SLAB,
                    known_state: str | None = None) -> DataFrame:
    """Gaps, filled signals, rates and the stateful driving style of every row."""
    tl = timeline(numeric_signals(df, ts), ts, partition_by, tie, rows_per_slab)
    return driving_style(fill_and_rate(tl), limits, known_state=known_state).frame


def style_summary(analysed: DataFrame, style: str = "driving_style_analyzed") -> DataFrame:
    return value_counts_pct(analysed, style)
