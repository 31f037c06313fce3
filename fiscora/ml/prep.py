"""Split by time and fit-on-train preparation of model features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fiscora.functions import numeric
from fiscora.operators import aggregates, columns

# Year ranges of the temporal split.
TRAIN_YEARS, VAL_YEARS, TEST_YEARS = (2011, 2018), (2019, 2020), (2021, 2022)
# Features clipped at the 99th percentile.
WINSORIZED = ("medicaid_pct", "current_ratio")
WINSOR_QUANTILE = 0.99
PREPARATION = "kind string, column_name string, value double"


def temporal_split(df: DataFrame, year: str, train: tuple[int, int] = TRAIN_YEARS,
                   val: tuple[int, int] = VAL_YEARS, test: tuple[int, int] = TEST_YEARS,
                   out: str = "split") -> DataFrame:
    """Label rows train/val/test by year; years outside all ranges are dropped."""
    y = F.col(year)
    name = (F.when(y.between(*train), "train").when(y.between(*val), "val")
            .when(y.between(*test), "test"))
    return df.filter(y.between(*train) | y.between(*val) | y.between(*test)).withColumn(out, name)


def winsorize_fit(df: DataFrame, cols: Sequence[str], where: str | Column | None = None,
                  q: float = WINSOR_QUANTILE) -> DataFrame:
    """One row of upper caps, fitted on the rows ``where`` selects."""
    return aggregates.fit_quantile(df, cols, q, where)


def winsorize_apply(df: DataFrame, caps: DataFrame, cols: Sequence[str]) -> DataFrame:
    return columns.with_params(
        df, caps, lambda p: {c: numeric.cap_upper(c, p[c]) for c in cols})


def impute_fit(df: DataFrame, cols: Sequence[str], where: str | Column | None = None,
               method: str = "interpolate") -> DataFrame:
    """One row of medians, fitted on the rows ``where`` selects."""
    return aggregates.fit_median(df, cols, where=where, method=method)


def impute_apply(df: DataFrame, medians: DataFrame, cols: Sequence[str]) -> DataFrame:
    return columns.with_params(
        df, medians, lambda p: {c: numeric.fill_with(c, p[c]) for c in cols})


def impute_by_group(df: DataFrame, cols: Sequence[str], by: Sequence[str],
                    where: str | Column | None = None, method: str = "interpolate") -> DataFrame:
    """Fill from the group's median, and from the global one where the group has none."""
    group = aggregates.fit_median(df, cols, by=by, where=where, method=method)
    wide = group.groupBy(*by).agg(*[
        F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(f"_m_{c}") for c in cols])
    side = wide.select(*[F.col(b).alias(f"_g_{b}") for b in by], *[f"_m_{c}" for c in cols])
    cond = F.lit(True)
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    filled = df.join(side, cond, "left").withColumns(
        {c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).select(*df.columns)
    overall = aggregates.fit_median(df, cols, where=where, method=method)
    return impute_apply(filled, overall, cols)


def standardize_apply(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores from a row of ``<col>__mean`` and ``<col>__std``."""
    return columns.with_params(df, fitted, lambda p: {
        c: numeric.standardize(c, p[f"{c}__mean"], p[f"{c}__std"]) for c in cols})


@dataclass(frozen=True)
class Preparation:
    """Caps and medians fitted on training rows, kept to treat any later rows alike."""
    caps: Mapping[str, float | None]
    medians: Mapping[str, float | None]

    @staticmethod
    def fit(df: DataFrame, features: Sequence[str] = numeric.FEATURE_COLUMNS,
            winsorized: Sequence[str] = WINSORIZED,
            where: str | Column | None = None) -> Preparation:
        """Medians are those of the capped rows."""
        caps = winsorize_fit(df, winsorized, where).first().asDict() if winsorized else {}
        capped = Preparation(caps, {}).apply(df)
        return Preparation(caps, impute_fit(capped, features, where).first().asDict())

    def apply(self, df: DataFrame) -> DataFrame:
        """Cap, then fill; a projection without join or shuffle. Values become doubles."""
        def value(v: float | None) -> Column:
            return F.lit(v).cast("double")

        capped = df.withColumns({c: numeric.cap_upper(c, value(v)) for c, v in self.caps.items()})
        return capped.withColumns(
            {c: numeric.fill_with(c, value(v)) for c, v in self.medians.items()})

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(kind, c, None if v is None else float(v))
                for kind, values in (("cap", self.caps), ("median", self.medians))
                for c, v in values.items()]
        spark.createDataFrame(rows, PREPARATION).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        rows = spark.read.schema(PREPARATION).parquet(path).collect()
        return Preparation(*({r["column_name"]: r["value"] for r in rows if r["kind"] == kind}
                             for kind in ("cap", "median")))


def prepare(df: DataFrame, features: Sequence[str] = numeric.FEATURE_COLUMNS,
            winsorized: Sequence[str] = WINSORIZED, split: str = "split") -> DataFrame:
    """Winsorize and impute all splits with values fitted on the training rows."""
    return Preparation.fit(df, features, winsorized, F.col(split) == "train").apply(df)
