"""Plans that must hold at any size: pruned scans, no pairing joins, split hot groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fiscora.ml import metrics
from fiscora.operators import ordered

SF_DIR = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "j1_lookup_left", "j2_match_exact", "j4_match_two_pass", "j5_attach_keys", "j7_flag_membership",
    "j9_broadcast_params", "a7_surrogate_key", "a8_median_by", "a10_fit_quantile",
    "a14_class_weights", "w1_dedup_best", "w2_lag_within", "m8_roc_auc", "m9_average_precision",
    "m12_fairness_by_group", "m13_compare_models", "m16_shap_summary", "x10_revenue_yoy_change"])
def test_no_pairing_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,scan", [
    ("p4_project", "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>"),
    ("p9_filter_sql", "LessThan(l_quantity,10.0)"),
    ("a1_count_by", "ReadSchema: struct<l_returnflag:string,l_linestatus:string>"),
    ("l0_margin_by_year", "ReadSchema: struct<c_custkey:bigint>"),
])
def test_scans_are_pruned(spark, name, scan):
    df = entry.queries()[name](spark, SF_DIR)
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    if name == "p9_filter_sql":
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert scan in text


def test_hot_score_is_merged_first(spark):
    """All rows share one score: what gets ordered is the written table of distinct scores."""
    df = spark.range(0, 100_000, 1, 8).select(
        F.lit(0.5).alias("s"), (F.col("id") % 2).cast("int").alias("y"))
    got = metrics.roc_auc(df, "s", "y").first()[0]
    assert got == 0.5
    text = plan(metrics.roc_auc(df, "s", "y"))
    assert "merged-" in text and "Range (" not in text


def test_one_group_is_ordered_by_many_tasks(spark):
    """A single group is cut into ranges of similar size."""
    df = spark.range(0, 50_000).select(F.exp(F.col("id") / 5000).alias("v"))
    sizes = [r["count"] for r in ordered.split_ranges(df, "v", bits=4).groupBy("_range").count()
             .collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 50_000 / 16
