"""Train, compare, evaluate and explain on the star schema."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.functions.numeric import FEATURE_COLUMNS, apply_threshold
from fiscora.ml import explain, metrics, oversample, prep, rounds, runs, score, train
from fiscora.operators import aggregates, joins, windows
from fiscora.session import hand_over

LABEL = "distress_label"


@dataclass
class Outcome:
    models: dict[str, train.Model]
    preparation: prep.Preparation
    paths: dict[str, str]
    splits: DataFrame
    rounds: DataFrame
    comparison: DataFrame
    best: str
    test_scores: DataFrame
    test_metrics: DataFrame
    report: DataFrame
    fairness: DataFrame
    importance: DataFrame
    waterfall: DataFrame


def model_rows(fact: DataFrame, dim_geography: DataFrame) -> DataFrame:
    return joins.attach_dim(fact, dim_geography, "geo_id", ["rural_level", "state_code"])


def train_all(rows: DataFrame, features: Sequence[str], label: str,
              settings: Mapping[str, Mapping] | None = None) -> dict[str, train.Model]:
    settings = settings or {}
    makers = {"LogisticRegression": train.train_logistic, "RandomForest": train.train_forest,
              "BoostedTrees": train.train_boosted}
    return {name: make(rows, features, label, **settings.get(name, {}))
            for name, make in makers.items()}


def score_long(models: Mapping[str, train.Model], rows: DataFrame,
               keep: Sequence[str]) -> DataFrame:
    """(model, keep..., score) for every model."""
    return windows.union_all([
        score.probability(model, rows, keep, "score").withColumn("model", F.lit(name))
        for name, model in models.items()])


def run(spark: SparkSession, fact: DataFrame, dim_geography: DataFrame, run_log: str,
        features: Sequence[str] = FEATURE_COLUMNS, label: str = LABEL,
        key: Sequence[str] = ("ccn_key", "fiscal_year"), years: Mapping[str, tuple] | None = None,
        settings: Mapping[str, Mapping] | None = None, best: str | None = None) -> Outcome:
    """The whole study. ``best`` fixes the final model, otherwise validation decides.

    Every model is saved with its caps and medians next to the run log, in a folder the log
    names; ``score.score_saved`` scores new rows from there.
    """
    split = hand_over(prep.temporal_split(
        model_rows(fact, dim_geography), "fiscal_year", **(years or {})), "split")
    winsorized = [c for c in prep.WINSORIZED if c in features]
    preparation = prep.Preparation.fit(split, features, winsorized, "split = 'train'")
    ready = hand_over(preparation.apply(split), "prepared")
    aggregates.require_no_nulls(ready, features)
    parts = {s: ready.filter(F.col("split") == s) for s in ("train", "val", "test")}
    balanced = hand_over(oversample.smote(parts["train"], features, label), "balanced")
    models = train_all(balanced, features, label, settings)

    keep = [*key, label, "rural_level"]
    val_scores = hand_over(score_long(models, parts["val"], keep), "val-scores")
    comparison = metrics.compare_models(val_scores, "model", "score", label)
    results = {r["model"]: r for r in comparison.collect()}
    run_ids, paths = {}, {}
    for name in models:
        paths[name] = f"{run_log.rstrip('/')}-models/{name}-{uuid.uuid4().hex}"
        score.save_scorer(spark, models[name], preparation, paths[name])
        run_ids[name] = runs.log_run(
            spark, run_log, name,
            {"model_type": name, "smote": True, "features": list(features),
             "model_path": paths[name], **dict((settings or {}).get(name, {}))},
            {"val_roc_auc": results[name]["roc_auc"],
             "val_pr_auc": results[name]["average_precision"]} if name in results else {})
    best = best or max(results, key=lambda m: results[m]["average_precision"] or 0.0)

    scored = score.probability(models[best], parts["test"], keep, "score")
    test_scores = hand_over(scored.withColumn("pred", apply_threshold("score")), "test-scores")
    test_metrics = metrics.ranking_metrics(test_scores, "score", label).withColumnsRenamed(
        {"roc_auc": "test_roc_auc", "average_precision": "test_pr_auc"})
    runs.log_metrics(test_metrics, run_log, best, run_ids[best])

    phi = hand_over(explain.shap_values(
        models[best], parts["test"], features, key, background=balanced), "shap")
    long = explain.shap_long(phi, features, key)
    top = windows.top_1(test_scores, "score", key)
    top_long = long.join(top.select(*key), list(key), "left_semi")
    splits = aggregates.rate(ready, label, ["split"])
    watched = hand_over(rounds.metrics_per_round(models["BoostedTrees"], parts["val"], label),
                        "rounds")
    return Outcome(
        models, preparation, paths, splits, watched, comparison, best, test_scores, test_metrics,
        metrics.classification_report(test_scores, "pred", label),
        metrics.fairness_by_group(test_scores, "rural_level", "score", "pred", label),
        explain.shap_summary(long), explain.shap_waterfall(top_long, key))
