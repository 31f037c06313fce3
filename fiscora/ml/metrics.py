"""Exact ranking and decision metrics as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fiscora.operators.ordered import running_sums

# Class names of the report and tiers of the fairness table.
CLASS_NAMES = ("Stable", "Distress")
FAIRNESS_TIERS = ("Micropolitan", "Small Town", "Remote Rural")


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                    min_positives: int = 1) -> DataFrame:
    """Both ranking metrics from one descending pass over the distinct scores.

    ``roc_auc`` needs both classes, ``average_precision`` at least
    ``min_positives`` positives; otherwise they are NULL.
    """
    sums = {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}
    ranked = running_sums(df, score, sums, by, descending=True)
    hits = F.col("pos_before") + F.col("pos")
    seen = hits + F.col("neg_before") + F.col("neg")
    positives, pairs = F.sum("pos"), F.sum("pos").cast("double") * F.sum("neg")
    # Pairs the negative wins; ties count half.
    lost = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy(*by).agg(
        F.when(pairs > 0, 1 - lost / pairs).alias("roc_auc"),
        F.when(positives >= min_positives, F.sum(F.col("pos") * hits / seen) / positives)
        .alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half."""
    return ranking_metrics(df, score, label, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = (),
                      min_positives: int = 1) -> DataFrame:
    """Sum of precision times recall gain over distinct scores, highest first."""
    return ranking_metrics(df, score, label, by, min_positives).select(*by, "average_precision")


def confusion(df: DataFrame, pred: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    p, y = F.col(pred) == 1, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & ~y).alias("tn"), F.count_if(~p & y).alias("fn"))


def _share(num: Column, den: Column) -> Column:
    """Quotient that is 0 where nothing was counted."""
    return F.when(den > 0, num / den).otherwise(0.0)


def classification_report(df: DataFrame, pred: str, label: str,
                          names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy and both averages."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn

    def scores(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        precision, recall = _share(hit, hit + wrong), _share(hit, hit + missed)
        return [precision, recall, _share(2 * precision * recall, precision + recall)]

    stable, distress = scores(tn, fn, fp), scores(tp, fp, fn)
    support = [tn + fp, tp + fn]
    accuracy = _share(tp + tn, n)
    rows = [
        (names[0], *stable, support[0]),
        (names[1], *distress, support[1]),
        ("accuracy", accuracy, accuracy, accuracy, n),
        ("macro avg", *[(a + b) / 2 for a, b in zip(stable, distress)], n),
        ("weighted avg", *[_share(a * support[0] + b * support[1], n)
                           for a, b in zip(stable, distress)], n),
    ]
    entries = [F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("bigint").alias("support"))
               for name, p, r, f, s in rows]
    return confusion(df, pred, label).select(F.inline(F.array(*entries)))


def fairness_by_group(df: DataFrame, group: str, score: str, pred: str, label: str,
                      tiers: Sequence[str] | None = FAIRNESS_TIERS) -> DataFrame:
    """False-positive rate, recall and average precision per tier.

    Rates without a denominator are NULL, average precision needs more than
    one positive.
    """
    kept = df.filter(F.col(group).isin(*tiers)) if tiers else df.filter(F.col(group).isNotNull())
    counts = confusion(kept, pred, label, [group]).select(
        group, (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("positives"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
    precision = average_precision(kept, score, label, [group], min_positives=2)
    return counts.join(precision, group, "left")


def compare_models(scores: DataFrame, model: str, score: str, label: str) -> DataFrame:
    """One row per model with both ranking metrics, best average precision first."""
    return ranking_metrics(scores, score, label, [model]).orderBy(
        F.desc("average_precision"), model)
