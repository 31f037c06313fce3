"""Per-row attributions of a score to its features: path-dependent Shapley values of trees
(``trees``), and weight times distance from the mean for linear models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fiscora.ml.boost import BoostedModel
from fiscora.ml.forest import ForestModel
from fiscora.ml.train import Model
from fiscora.ml.trees import Tree, attributions
from fiscora.session import scratch_path

ROWS_AT_ONCE = 1 << 14      # rows of a task for which every tree is walked once


def model_trees(model: PipelineModel, spark) -> list[Tree]:
    """The trees of an MLlib forest, each worth its share of the probability; bounded by trees x
    2**depth, never by data."""
    ensemble = model.stages[-1]
    path = scratch_path(spark, "trees")
    ensemble.write().overwrite().save(path)
    weights = list(ensemble.treeWeights)
    total = sum(weights)
    found: dict[int, list] = {}
    for tree, node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        stats, split = node["impurityStats"], node["split"]
        value = stats[1] / sum(stats)
        found.setdefault(tree, []).append((
            node["id"], split["featureIndex"], (list(split["leftCategoriesOrThreshold"]) or [np.nan])[0],
            node["leftChild"], node["rightChild"], value * weights[tree] / total, node["rawCount"]))
    out = []
    for _, nodes in sorted(found.items()):
        ids, *columns = zip(*sorted(nodes))
        place = {i: k for k, i in enumerate(ids)}
        feature, threshold, left, right, value, cover = columns
        out.append(Tree(np.array(feature), np.array(threshold, float),
                        np.array([place.get(i, -1) for i in left]), np.array([place.get(i, -1) for i in right]),
                        np.array(value, float), np.array(cover, float)))
    return out


def _phi(feature: str) -> str:
    return f"phi_{feature}"


def shap_values(model: Model, df: DataFrame, features: Sequence[str],
                keep: Sequence[str] = (), background: DataFrame | None = None) -> DataFrame:
    """``keep`` columns, ``base_value`` and ``phi_<feature>`` for every row.

    Linear models need ``background``, the rows they were trained on: a row's
    attributions must not depend on what it is explained together with.

    base_value plus the attributions is the log-odds (boosted trees, logistic) or the
    probability (forest).
    """
    features = list(features)
    if isinstance(model, (BoostedModel, ForestModel)):
        if features != list(model.features):
            raise ValueError("features must be those of the model, in its order")
    elif hasattr(model.stages[-1], "coefficients"):
        if background is None:
            raise ValueError("a linear model is explained against background rows")
        return _linear_shap(model, df, features, keep, background)
    spark = df.sparkSession
    ensemble = model.trees if isinstance(model, (BoostedModel, ForestModel)) else model_trees(model, spark)
    base = sum(tree.mean() for tree in ensemble)
    shared = spark.sparkContext.broadcast(ensemble)
    schema = StructType(df.select(*keep).schema.fields + [StructField("base_value", DoubleType())] + [
        StructField(_phi(f), DoubleType()) for f in features])
    inputs = df.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}")
                                for i, f in enumerate(features)])
    places = [f"_x{i}" for i in range(len(features))]

    def explained(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        phi = attributions(rows[places].to_numpy(dtype=float), shared.value)
        out = rows.drop(columns=places)
        out["base_value"] = base
        for i, f in enumerate(features):
            out[_phi(f)] = phi[:, i]
        return out

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= ROWS_AT_ONCE:
                yield explained(held)
                held, size = [], 0
        if size:
            yield explained(held)

    return inputs.mapInPandas(explain, schema)


def linear_attributions(df: DataFrame, weights: dict[str, float], intercept: float,
                        keep: Sequence[str], background: DataFrame) -> DataFrame:
    """Attributions weight * (x - mean); the means come from ``background`` rows."""
    means = background.agg(*[F.avg(f).alias(f) for f in weights]).select(
        F.struct("*")).scalar()
    base = F.lit(intercept)
    for f, w in weights.items():
        base = base + means[f] * w
    return df.select(*keep, base.alias("base_value"),
                     *[((F.col(f) - means[f]) * w).alias(_phi(f)) for f, w in weights.items()])


def _linear_shap(model: PipelineModel, df: DataFrame, features: Sequence[str],
                 keep: Sequence[str], background: DataFrame) -> DataFrame:
    last = model.stages[-1]
    scale = np.ones(len(features))
    for stage in model.stages[:-1]:
        if stage.hasParam("scalingVec"):
            scale = scale * np.asarray(stage.getOrDefault("scalingVec"))
    weights = dict(zip(features, (float(w) for w in last.coefficients.toArray() * scale)))
    return linear_attributions(df, weights, float(last.intercept), keep, background)


def shap_long(wide: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (row, feature): keep..., base_value, feature, phi."""
    named = wide.select(*keep, "base_value", *[F.col(_phi(f)).alias(f) for f in features])
    return named.unpivot([*keep, "base_value"], list(features), "feature", "phi")


def shap_summary(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, most important first."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(
        F.desc("mean_abs_phi"), "feature")


def shap_waterfall(long: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Contributions as stacked steps from the base value to the score.

    ``position`` 1 is the largest contribution; it is the last step and ends
    at the score. An entity has one row per feature.
    """
    size = F.abs("phi")
    largest = Window.partitionBy(*entity).orderBy(size.desc(), "feature")
    smallest = (Window.partitionBy(*entity).orderBy(size.asc(), F.desc("feature"))
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    end = F.col("base_value") + F.sum("phi").over(smallest)
    return long.select(*entity, F.row_number().over(largest).alias("position"), "feature", "phi",
                       (end - F.col("phi")).alias("start_value"), end.alias("end_value"))
