"""Scoring tables with a trained pipeline, and checking their input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.functions.numeric import FEATURE_COLUMNS, risk_tier, round_score
from fiscora.ml.boost import BoostedModel, boosted_margin
from fiscora.ml.forest import ForestModel, forest_probability
from fiscora.ml.prep import Preparation
from fiscora.ml.train import Model, load_model, save_model

# Smallest and largest sensible input per feature.
FEATURE_DOMAIN = {
    "operating_margin": (-0.5, 0.3), "total_margin": (-0.5, 0.3),
    "cost_to_revenue": (0.5, 2.0), "medicaid_pct": (0.0, 1.0),
    "medicare_day_pct": (0.0, 1.0), "occupancy_proxy": (0.0, 1.0),
    "days_cash_on_hand": (0.0, 200.0), "current_ratio": (0.0, 5.0),
    "uncompensated_care_pct": (0.0, 0.5), "revenue_yoy_change": (-0.3, 0.3),
}


def probability(model: Model, df: DataFrame, keep: Sequence[str],
                out: str = "probability") -> DataFrame:
    """Probability of the positive class next to the ``keep`` columns."""
    if isinstance(model, BoostedModel):
        margin = boosted_margin(model, df, keep, "_margin")
        return margin.select(*keep, (F.lit(1.0) / (1 + F.exp(-F.col("_margin")))).alias(out))
    if isinstance(model, ForestModel):
        return forest_probability(model, df, keep, out)
    scored = model.transform(df)
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def score_batch(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, ``risk_score`` (4 decimals) and ``risk_tier``.

    The tier is taken from the unrounded probability.
    """
    return probability(model, df, keep, "_p").select(
        *keep, round_score("_p").alias("risk_score"), risk_tier("_p").alias("risk_tier"))


def save_scorer(spark: SparkSession, model: Model, preparation: Preparation,
                path: str) -> None:
    """Keep a model together with the caps and medians its rows were prepared with."""
    save_model(model, f"{path}/model")
    preparation.save(spark, f"{path}/preparation")


def load_scorer(spark: SparkSession, path: str) -> tuple[Model, Preparation]:
    return load_model(f"{path}/model"), Preparation.load(spark, f"{path}/preparation")


def score_saved(spark: SparkSession, path: str, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Score raw rows, gaps included, with what ``save_scorer`` kept."""
    model, preparation = load_scorer(spark, path)
    return score_batch(model, preparation.apply(df), keep)


def validate_input(df: DataFrame, features: Sequence[str] = FEATURE_COLUMNS,
                   domain: Mapping[str, tuple[float, float]] | None = None,
                   ) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, with features as double; rejected, with ``reasons``).

    A feature must be present and numeric; with ``domain`` also in range.
    Columns the table lacks altogether count as absent in every row.
    """
    given = df.withColumns({f: F.lit(None).cast("string") for f in features
                            if f not in df.columns})
    problems = []
    for f in features:
        number = F.col(f).try_cast("double")
        check = (F.when(F.col(f).isNull(), F.lit(f"{f}: missing"))
                 .when(number.isNull(), F.lit(f"{f}: not a number")))
        if domain and f in domain:
            low, high = domain[f]
            check = check.when(~number.between(low, high), F.lit(f"{f}: out of range"))
        problems.append(check)
    checked = given.withColumn("reasons", F.array_compact(F.array(*problems)))
    good = F.size("reasons") == 0
    valid = checked.filter(good).drop("reasons").withColumns(
        {f: F.col(f).try_cast("double") for f in features})
    return valid, checked.filter(~good)
