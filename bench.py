"""Times the headline queries and prints one JSON line.

Every result is computed in full (all rows and columns go to a no-op sink).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "k10_analyse_driving", "k1_clean_session", "k2_clean_trials", "k3_label_sessions", "k4_driver_features",
    "k7_rule_maintenance_need", "k11_clean_drive_files", "k12_maintenance_features", "k13_truck_table",
    "n4_forward_fill", "n4_forward_fill_whole_log", "n6_rolling_std", "n9_idle_runs", "n11_driving_style_latch",
    "g4_describe_numeric", "g8_median_per_column", "g11_quantile_table", "g13_correlation_matrix", "g16_chi2_score",
    "g17_histogram", "g20_distinct_rows", "g21_dedup_by_key_first", "f7_min_max_scale", "f16_cap_at_quantile",
    "f22_label_encode", "j1_inner_equi_join", "j2_left_equi_join", "p18_drop_identical_columns", "s1_csv_scan",
    "m8_isolation_forest_flag", "m10_pca_project", "m12_kmeans_cluster", "m16_iterative_impute", "m21_rbf_outlier_flag",
    "t5_driving_style_stream",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from bindings import REGISTRY

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if "spark.checkpoint.dir" not in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("g2_value_counts_pct")  # the first query pays for starting the engine
    times = {name: run(name) for name in names}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
