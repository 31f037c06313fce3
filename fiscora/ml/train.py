"""The three classifiers on raw feature columns: an MLlib pipeline, and trees (``forest``, ``boost``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.ml.boost import (
    BoostedModel, fit_boosted, load_boosted, save_boosted, staged_margins)
from fiscora.ml.forest import ForestModel, fit_forest
from fiscora.operators import aggregates

Model = PipelineModel | BoostedModel | ForestModel

VECTOR = "_features"


def _assembler(features: Sequence[str], out: str = VECTOR) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error")


def _as_label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("double"))


def train_logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0,
                   max_iter: int = 1000) -> PipelineModel:
    """Balanced logistic regression on features scaled by their deviation.

    The penalty equals an inverse strength of ``c`` on summed losses: MLlib
    averages losses over the weights, which sum to the row count. Centring
    is left out because it only moves the unpenalised intercept.
    """
    row = df.agg(F.count("*").alias("_n"),
                 *[F.stddev_pop(f).alias(f"{f}__std") for f in features]).first()
    scale = Vectors.dense([1.0 / (row[f"{f}__std"] or 1.0) for f in features])
    weighted = aggregates.class_weights(_as_label(df, label), label, "_weight")
    return Pipeline(stages=[
        _assembler(features, "_raw"),
        ElementwiseProduct(scalingVec=scale, inputCol="_raw", outputCol=VECTOR),
        LogisticRegression(featuresCol=VECTOR, labelCol=label, weightCol="_weight",
                           standardization=False, maxIter=max_iter,
                           regParam=1.0 / (c * row["_n"])),
    ]).fit(weighted)


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300,
                 depth: int = 12, seed: int = 42, bins: int = 64) -> ForestModel:
    """Balanced random forest."""
    return fit_forest(df, features, label, trees, depth, seed, bins)


def train_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 300,
                  rate: float = 0.05, depth: int = 5, bins: int = 64) -> BoostedModel:
    """Gradient-boosted trees with positives weighted by negatives / positives."""
    return fit_boosted(df, features, label, rounds, rate, depth, bins)


def watch_boosted(model: BoostedModel, df: DataFrame, label: str) -> list[float]:
    """Mean log loss on a watched set after each round; it never stops the training."""
    # log(1 + e**-m) of the margin towards the label, without overflow.
    towards = F.when(F.col(label) == 1, F.col("_margin")).otherwise(-F.col("_margin"))
    loss = F.greatest(-towards, F.lit(0.0)) + F.log1p(F.exp(-F.abs("_margin")))
    rows = staged_margins(model, df, [label]).select(label, F.posexplode("margins").alias("_round", "_margin"))
    return [r["loss"] for r in rows.groupBy("_round").agg(F.avg(loss).alias("loss")).orderBy("_round").collect()]


def save_model(model: Model, path: str) -> None:
    """Trees are saved as tables, those of a forest in a folder of that name."""
    if isinstance(model, BoostedModel):
        save_boosted(SparkSession.getActiveSession(), model, path)
    elif isinstance(model, ForestModel):
        save_boosted(SparkSession.getActiveSession(), BoostedModel(model.features, model.trees), f"{path}/forest")
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    spark = SparkSession.getActiveSession()

    def there(name: str) -> bool:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)

    if there("nodes"):
        return load_boosted(spark, path)
    if there("forest"):
        found = load_boosted(spark, f"{path}/forest")
        return ForestModel(found.features, found.trees)
    return PipelineModel.load(path)
