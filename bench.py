"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fiscora.session import scratch_scope  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "l0_margin_by_year", "j4_match_two_pass", "j5_attach_keys", "j9_broadcast_params",
    "a1_count_by", "a7_surrogate_key", "a8_median_by", "a10_fit_quantile", "a11_describe",
    "w1_dedup_best", "w2_lag_within", "w2_lag_within_3", "w7_verify_unique",
    "x10_revenue_yoy_change", "f3_normalize_name", "m3_impute_fit_apply", "m4_smote",
    "m5_train_logistic", "m7_train_boosted", "m8_roc_auc", "m9_average_precision",
    "m13_compare_models", "m15_shap_values", "m15_shap_trees", "m16_shap_summary", "m19_validate_input",
    "k5_append_bronze_stream", "l2_silver", "l3_gold",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("fiscora-bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    wanted = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        with scratch_scope(spark):
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds,
                      "sf": float(scale.group(1)) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
