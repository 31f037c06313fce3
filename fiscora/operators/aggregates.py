"""Counts, rates, profiles and fitted statistics.

All of them aggregate map-side first; what is shuffled is one row per group
and task, however unevenly the rows are spread over the groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fiscora.operators import ordered


def count_by(df: DataFrame, keys: Sequence[str], order: bool = True) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("count"))
    return counts.orderBy(*keys) if order else counts


def rate(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, positives and positive share."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.sum(F.col(label).cast("bigint")).alias("positives"),
        F.avg(label).alias("rate"))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column_name, nulls) from a single pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column_name", "nulls")


def null_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (column_name, null_rate), worst first."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return row.unpivot([], list(cols), "column_name", "null_rate").orderBy(
        F.desc("null_rate"), "column_name")


def require_no_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail if a column still has missing values."""
    left = {r["column_name"]: r["nulls"] for r in null_counts(df, cols).collect() if r["nulls"]}
    if left:
        raise ValueError(f"missing values remain: {left}")
    return df


def distinct_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of distinct key tuples; a NULL part counts as a value."""
    return df.select(*keys).distinct().agg(F.count("*").alias("entities"))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def avg_by(df: DataFrame, keys: Sequence[str], col: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias(out))


def median_by(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Median per group; groups without a value give NULL."""
    medians = ordered.exact_quantile(df, [col], 0.5, by=keys, keep_empty=True)
    return medians.select(*keys, F.col("value").alias(f"median_{col}"))


def fit_median(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
               where: str | Column | None = None, method: str = "interpolate") -> DataFrame:
    """Medians, fitted only on rows that satisfy ``where``.

    Global: one row with a column per input. With ``by``: rows (by..., column
    name, n, value).
    """
    fitted_on = df if where is None else df.filter(where)
    quantiles = ordered.exact_quantile(fitted_on, cols, 0.5, by=by, method=method)
    return quantiles if by else ordered.one_row(quantiles, cols)


def fit_quantile(df: DataFrame, cols: Sequence[str], q: float,
                 where: str | Column | None = None) -> DataFrame:
    """One row with the linearly interpolated quantile of each column."""
    fitted_on = df if where is None else df.filter(where)
    return ordered.one_row(ordered.exact_quantile(fitted_on, cols, q), cols)


def _stacked(row: DataFrame, cols: Sequence[str], stats: Sequence[str],
             facts: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Turn the one row ``<col>__<stat>`` into a row per column; ``facts`` adds constants."""
    entry = [F.struct(F.lit(c).alias("column_name"),
                      *[F.lit(values[i]).alias(k) for k, values in (facts or {}).items()],
                      *[F.col(f"{c}__{s}").alias(s) for s in stats])
             for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*entry)))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum per column."""
    stats = {"count": F.count, "mean": F.avg, "stddev": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[fn(F.col(c).cast("double") if s != "count" else F.col(c)).alias(f"{c}__{s}")
                   for c in cols for s, fn in stats.items()])
    return _stacked(row, cols, list(stats))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: place, type, rows, missing values and an example value."""
    cols = df.columns
    row = df.agg(*[c for name in cols for c in (
        F.count("*").alias(f"{name}__row_count"),
        F.count_if(F.col(name).isNull()).alias(f"{name}__null_count"),
        F.min(F.col(name).cast("string")).alias(f"{name}__example"))])
    return _stacked(row, cols, ["row_count", "null_count", "example"],
                    {"position": range(len(cols)), "dtype": [t for _, t in df.dtypes]})


def fit_standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column."""
    return df.agg(*[c for name in cols for c in (
        F.avg(name).alias(f"{name}__mean"), F.stddev_pop(name).alias(f"{name}__std"))])


def fit_class_weights(df: DataFrame, label: str) -> DataFrame:
    """One row: balanced weight of either class and the positive weight."""
    n, pos = F.count(label), F.count_if(F.col(label) == 1)
    neg = n - pos
    return df.agg(
        F.try_divide(n, 2 * neg).alias("weight_0"), F.try_divide(n, 2 * pos).alias("weight_1"),
        F.try_divide(neg, pos).alias("pos_weight"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Add the balanced class weight n / (2 n_class) to every row."""
    fitted = fit_class_weights(df, label).select(F.struct("*")).scalar()
    return df.withColumn(out, F.when(F.col(label) == 1, fitted["weight_1"])
                         .otherwise(fitted["weight_0"]))
