"""Deduplication, prior-row values, sorting, sampling and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from fiscora.functions import numeric


def dedup_best(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
               tie_breaks: Sequence[str | Column] = ()) -> DataFrame:
    """Keep the most complete row per key.

    ``tie_breaks`` (highest value wins unless an ordered column is given)
    should make the order total. Spark keeps only the best row per key and
    task before the shuffle, so a hot key moves one row per task.
    """
    ties = [F.desc(t) if isinstance(t, str) else t for t in tie_breaks]
    best = Window.partitionBy(*keys).orderBy(F.desc("_filled"), *ties)
    return (df.withColumn("_filled", numeric.completeness(cols))
            .withColumn("_nth", F.row_number().over(best))
            .filter(F.col("_nth") == 1)
            .drop("_filled", "_nth"))


def yoy_change(df: DataFrame, key: str, period: str, col: str, out: str,
               require_gap: int | None = None) -> DataFrame:
    """Relative change against the row before in the same key.

    (key, period) must be unique, as after deduplication: a key then has no
    more rows than there are periods. ``require_gap`` = 1 demands that the
    row before is the period before.
    """
    history = Window.partitionBy(key).orderBy(period)
    prior = F.lag(col).over(history)
    if require_gap is not None:
        prior = F.when(F.col(period) - F.lag(period).over(history) == require_gap, prior)
    return (df.withColumn("_prior", prior)
            .withColumn(out, numeric.yoy(col, "_prior")).drop("_prior"))


def top_1(df: DataFrame, score: str, ties: Sequence[str]) -> DataFrame:
    """Row with the highest score, first by ``ties``."""
    return df.orderBy(F.desc_nulls_last(score), *ties).limit(1)


def sort_by(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*cols)


def sample_head(df: DataFrame, n: int, order: Sequence[str | Column] = ()) -> DataFrame:
    """First ``n`` rows; with ``order`` only those ``n`` per task are kept and merged."""
    return (df.orderBy(*order) if order else df).limit(n)


def verify_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, surplus rows and keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus_rows"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_synthetic(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Append generated rows to the real ones."""
    return real.unionByName(synthetic.select(*real.columns))
