"""Session labels, driver features and style clusters: K3-K5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torqueline.functions.numeric import eps_ratio, row_mean
from torqueline.functions.text import canonical_label
from torqueline.operators.encode import label_encode
from torqueline.operators.ml import (
    adjusted_rand_index, kmeans_cluster, normalized_mutual_info, pca_project, silhouette,
)
from torqueline.operators.rows import dedup_by_key_first, require_any_present
from torqueline.operators.scaling import min_max
from torqueline.operators.sequence import delta, forward_fill, rolling_std, sessions_and_idle
from torqueline.operators.timeline import timeline
from torqueline.schema import SIGNALS
from torqueline.session import settle

# Signals the driver features start from.
DRIVER_SIGNALS = ["RPM", "THROTTLE_POS", "SPEED", "ENGINE_LOAD", "MAF", "INTAKE_PRESSURE"]


def label_sessions(df: DataFrame, ts: str = "timestamp", partition_by: Sequence[str] = (), tie: Sequence[str] = (),
                   labels: DataFrame | None = None, session_gap_s: float = 3600, idle_s: float = 60,
                   label: str = "driving_style") -> DataFrame:
    """One row per timestamp with gap, session number and label; long standstills become ``idle``.

    ``labels`` holds label rows read apart from the signals; without it the label is a
    column of ``df`` and stays in its row.
    """
    keys = [*partition_by, ts]
    order = list(tie) or [ts]
    signals = [c for c in SIGNALS if c in df.columns]
    if labels is None and label in df.columns:
        df = df.withColumn(label, canonical_label(label))
    keep = [*keys, *[c for c in tie if c not in keys], *signals, *([label] if label in df.columns else [])]
    rows = dedup_by_key_first(df.select(*dict.fromkeys(keep)).dropna(subset=[ts]), keys, order)
    if labels is not None:
        named = labels.dropna(subset=[ts]).withColumn(label, canonical_label(label))
        named = dedup_by_key_first(named, keys, [c for c in order if c in labels.columns] or [ts])
        rows = rows.drop(label).join(named.select(*keys, label), keys, "left")
    rows = require_any_present(rows, signals)
    tl = timeline(rows, ts, partition_by, [c for c in tie if c != ts])
    return sessions_and_idle(tl, session_gap_s, idle_s, "SPEED", label).frame


def labelled_only(df: DataFrame, label: str = "driving_style") -> DataFrame:
    return df.dropna(subset=[label])


def driver_features(df: DataFrame, ts: str = "timestamp", partition_by: Sequence[str] = (), tie: Sequence[str] = (),
                    label: str = "driving_style") -> DataFrame:
    """Ratios, short-term variation and combined indices per row, with label and label code."""
    keep = dict.fromkeys([*partition_by, ts, *tie, *DRIVER_SIGNALS, label])
    tl = timeline(df.select(*keep), ts, partition_by, tie)
    tl = forward_fill(tl, DRIVER_SIGNALS)
    tl = tl.with_frame(tl.df.dropna(subset=DRIVER_SIGNALS))
    tl = tl.with_columns({
        "RPM_per_speed": eps_ratio("RPM", "SPEED"),
        "throttle_per_rpm": eps_ratio("THROTTLE_POS", "RPM"),
    })
    tl = rolling_std(tl, "SPEED", "speed_rolling_std", 3)
    tl = delta(tl, "THROTTLE_POS", "delta_throttle")
    # bounds and label codes are read off the sorted rows: scan and sort them once
    out = settle(tl.frame, "features").withColumn("engine_activity", row_mean("ENGINE_LOAD", "MAF"))
    out = min_max(out, ["SPEED", "RPM"], suffix="__01")
    out = out.withColumn("speed_rpm_index", row_mean("SPEED__01", "RPM__01"))
    out = out.drop("ENGINE_LOAD", "MAF", "SPEED", "RPM", "SPEED__01", "RPM__01")
    return label_encode(out, [label], suffix="_code")


def cluster_styles(df: DataFrame, features: Sequence[str], ts: str = "timestamp", partition_by: Sequence[str] = (),
                   tie: Sequence[str] = (), label: str = "driving_style", k: int = 4,
                   seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows with cluster and two components, and the agreement of clusters with labels."""
    tl = forward_fill(timeline(df, ts, partition_by, tie), features)
    # clustering reads the rows many times: scan and sort them once
    rows = settle(min_max(tl.frame.dropna(subset=list(features)), features), "features")
    clustered = kmeans_cluster(pca_project(rows, features, 2, scaled=False), features, k, seed)
    near = silhouette(clustered, features).first()["silhouette"]
    scores = adjusted_rand_index(clustered, label, "cluster").select(
        F.lit(near).cast("double").alias("silhouette"), "ari",
        normalized_mutual_info(clustered, label, "cluster").scalar().alias("nmi"),
    )
    return clustered, scores
