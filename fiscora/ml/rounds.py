"""How a boosted model ranks a watched set after each of its rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fiscora.ml.boost import BoostedModel, staged_margins
from fiscora.ml.metrics import ranking_metrics


def metrics_per_round(model: BoostedModel, df: DataFrame, label: str) -> DataFrame:
    """(round, roc_auc, average_precision) on the watched rows, for every round from 1."""
    staged = staged_margins(model, df, [label]).select(
        label, F.posexplode("margins").alias("_at", "_margin"))
    return ranking_metrics(staged.withColumn("round", F.col("_at") + 1), "_margin", label, ["round"])
